"""All queries of the ledger by name, over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_to_timestamp, vsize
from ..operators import flatten
from ..operators.checks import CHECKS, fee_summary, size_summary
from ..sources.store import plan
from . import oracle
from .bridge import ledger_of, raw_of
from .explore import EXPLORE
from .gate import severities
from .summary import SUMMARY
from .warehouse import MODELS, build, data_tests, upsert

LO, HI = oracle.LO, oracle.HI
Query = Callable[[SparkSession, str], DataFrame]

DATA = {"blocks": "blocks", "transactions": "transactions", "inputs": "inputs", "outputs": "outputs"}


def _sources(spark: SparkSession, sf: str, kind: str) -> dict[str, DataFrame]:
    led = ledger_of(spark, sf, kind)
    return {n: getattr(led, n) for n in DATA}


def _window(spark: SparkSession, sf: str, kind: str):
    return ledger_of(spark, sf, kind).window(LO, HI)


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions of even heights loaded, then those of heights divisible by 3 with a new fee: updates and inserts."""
    t = ledger_of(spark, sf).transactions
    staged = t.where(F.col("block_height") % 3 == 0).withColumn("fee_sats", F.col("fee_sats") + 1)
    return upsert(t.where(F.col("block_height") % 2 == 0), staged, ["txid"]).select("txid", "block_height", "fee_sats")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    """What the planner says is still to build, where outputs have partitions of heights under 50 alone."""
    led = ledger_of(spark, sf)
    heights = lambda df: {r[0] for r in df.select("block_height").distinct().collect()}
    done = set.intersection(heights(led.blocks), heights(led.transactions), heights(led.inputs), heights(led.outputs.where("block_height < 50")))
    return spark.createDataFrame([(h,) for h in plan(None, heights(led.blocks), done)["todo"]], "block_height bigint")


def _flat(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A dataset flattened out of the nested ledger."""
    raw = raw_of(spark, sf)
    if name == "blocks":
        return flatten.blocks(raw.blocks)
    return getattr(flatten, name)(raw.transactions.withColumns({"block_height": F.col("status.block_height"), "block_hash": F.col("status.block_hash")}))


def _props(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.from_json("props", "k bigint")["k"]
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for n in DATA:
        out[f"ds_{n}"] = lambda s, d, n=n: getattr(ledger_of(s, d), n)
        out[f"f_{n}"] = lambda s, d, n=n: _flat(s, d, n)
    for c in CHECKS:
        out[c.name] = lambda s, d, c=c: c.rows(_window(s, d, "dirty"))
    out["g26_coverage"] = lambda s, d: fee_summary(_window(s, d, "dirty"))
    out["gate_severity"] = lambda s, d: severities(_window(s, d, "dirty"))
    out["gate_severity_clean"] = lambda s, d: severities(_window(s, d, "clean"))
    out["gate_size_weight_vsize"] = lambda s, d: size_summary(_window(s, d, "dirty"))
    for n, q in SUMMARY.items():
        out[n] = lambda s, d, q=q: q(_window(s, d, "clean"))
    for n, q in EXPLORE.items():
        out[n] = lambda s, d, q=q: q(raw_of(s, d))
    out["e01_block_summary"] = lambda s, d: EXPLORE["e01_block_summary"](raw_of(s, d)).withColumn("block_time", F.col("block_time").cast("timestamp_ntz"))
    for m in MODELS:
        out[f"w_{m.name}"] = lambda s, d, m=m: build(_sources(s, d, "clean"), m.name)[m.name]
    for n in TESTS:
        out[n] = lambda s, d, n=n: data_tests(build(_sources(s, d, "dirty")))[n]()
    out["x_upsert_merge"] = _merge
    out["x_incremental_plan"] = _plan
    out["x_json_props"] = _props
    out["x_epoch_to_ts"] = lambda s, d: ledger_of(s, d).blocks.select("block_height", epoch_to_timestamp(F.col("timestamp")).alias("block_time"))
    out["x_vsize"] = lambda s, d: ledger_of(s, d).transactions.select("txid", vsize(F.col("weight_units")).alias("vsize"))
    return out


_COLS = {
    "stg_blocks": 'block_height, block_hash, previous_block_hash, make_timestamp("timestamp" * 1000000) AS block_timestamp, transaction_count, size_bytes, weight_units, difficulty, merkle_root, nonce, bits',
    "stg_transactions": "*",
    "stg_transaction_inputs": '* EXCLUDE ("sequence"), "sequence" AS sequence_number',
    "stg_transaction_outputs": "*",
}
_OF = {"blocks": "blocks", "transactions": "transactions", "transaction_inputs": "inputs", "transaction_outputs": "outputs"}
_ID = {"blocks": ", CAST(block_height AS VARCHAR) || '-' || block_hash AS block_id", "transactions": "", "transaction_inputs": ", txid || '-' || CAST(input_index AS VARCHAR) AS input_id", "transaction_outputs": ", txid || '-' || CAST(output_index AS VARCHAR) AS output_id"}


def _core(short: str) -> str:
    return f"(SELECT {_COLS['stg_' + short]}{_ID[short]} FROM {_OF[short]})"


def _test_sql() -> dict[str, str]:
    b, t, i, o = (_core(s) for s in _OF)
    uni = lambda src, c: f"SELECT {c}, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"
    nul = lambda src, c, w="TRUE": f"SELECT * FROM {src} WHERE {w} AND {c} IS NULL"
    neg = lambda src, c, w="TRUE", op="<": f"SELECT * FROM {src} WHERE {w} AND {c} {op} 0"
    rel = lambda src, c, parent, to: f"SELECT * FROM {src} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {to} FROM {parent})"
    return {
        "t_unique_blocks_block_id": uni(b, "block_id"), "t_unique_transactions_txid": uni(t, "txid"), "t_unique_inputs_input_id": uni(i, "input_id"), "t_unique_outputs_output_id": uni(o, "output_id"),
        "t_not_null_blocks_block_height": nul(b, "block_height"), "t_not_null_blocks_block_hash": nul(b, "block_hash"), "t_not_null_blocks_block_id": nul(b, "block_id"), "t_not_null_transactions_txid": nul(t, "txid"),
        "t_not_null_inputs_input_id": nul(i, "input_id"), "t_not_null_outputs_output_id": nul(o, "output_id"),
        "t_not_null_inputs_previous_txid": nul(i, "previous_txid", "NOT is_coinbase"), "t_not_null_inputs_previous_vout_index": nul(i, "previous_vout_index", "NOT is_coinbase"),
        "t_relationships_transactions_blocks": rel(t, "block_height", "blocks", "block_height"), "t_relationships_inputs_transactions": rel(i, "txid", "transactions", "txid"), "t_relationships_outputs_transactions": rel(o, "txid", "transactions", "txid"),
        "t_nonnegative_blocks_transaction_count": neg(b, "transaction_count"), "t_nonnegative_transactions_transaction_index": neg(t, "transaction_index"), "t_nonnegative_transactions_fee_sats": neg(t, "fee_sats", "NOT is_coinbase"),
        "t_nonnegative_inputs_previous_output_value_sats": neg(i, "previous_output_value_sats"), "t_nonnegative_outputs_value_sats": neg(o, "value_sats"), "t_positive_blocks_weight_units": neg(b, "weight_units", op="<="),
        "t_singular_block_tx_counts_match": oracle.GATE["g04"],
        "t_singular_one_coinbase_per_block": "SELECT block_height, count(*) AS coinbase_count FROM transactions WHERE is_coinbase GROUP BY 1 HAVING count(*) <> 1",
        "t_singular_internal_inputs_resolve_uniquely": oracle.GATE["g21"], "t_singular_fee_arithmetic_matches": oracle.GATE["g26"], "t_singular_vsize_matches_formula": oracle.GATE["g31"],
    }


TESTS = tuple(_test_sql())


def oracle_sql() -> dict[str, str]:
    out = {f"ds_{n}": oracle.clean(f"SELECT * FROM {n}") for n in DATA}
    out |= {f"f_{n}": oracle.clean(f"SELECT * FROM {n}") for n in DATA}
    out["f_transactions"] = oracle.clean("SELECT * REPLACE (CAST(ceil(weight_units / 4.0) AS BIGINT) AS vsize) FROM transactions")
    # Outputs are numbered by their place; the bridge's own numbers have gaps.
    out["f_outputs"] = oracle.clean("SELECT * REPLACE (row_number() OVER (PARTITION BY txid ORDER BY output_index) - 1 AS output_index) FROM outputs")
    for c in CHECKS:
        out[c.name] = oracle.dirty(oracle.GATE[f"g{c.number:02d}"])
    out["g26_coverage"] = oracle.dirty(oracle.FEE_COVERAGE)
    out["gate_severity"] = oracle.dirty(oracle.severities(CHECKS))
    out["gate_severity_clean"] = oracle.clean(oracle.severities(CHECKS))
    out["gate_size_weight_vsize"] = oracle.dirty(oracle.SIZES)
    out |= {n: oracle.clean(q) for n, q in (oracle.SUMMARY | oracle.EXPLORE).items()}
    for short in _OF:
        out[f"w_stg_{short}"] = oracle.clean(f"SELECT {_COLS['stg_' + short]} FROM {_OF[short]}")
        out[f"w_core_{short}"] = oracle.clean(f"SELECT * FROM {_core(short)}")
    out |= {n: oracle.dirty(q) for n, q in _test_sql().items()}
    out["x_upsert_merge"] = oracle.clean("SELECT txid, block_height, fee_sats + CASE WHEN block_height % 3 = 0 THEN 1 ELSE 0 END AS fee_sats FROM transactions WHERE block_height % 2 = 0 OR block_height % 3 = 0")
    out["x_incremental_plan"] = oracle.clean("SELECT DISTINCT block_height FROM blocks WHERE NOT EXISTS (SELECT 1 FROM outputs u WHERE u.block_height = blocks.block_height AND u.block_height < 50)")
    out["x_json_props"] = "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS min_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1"
    out["x_epoch_to_ts"] = oracle.clean('SELECT block_height, make_timestamp("timestamp" * 1000000) AS block_time FROM blocks')
    out["x_vsize"] = oracle.clean("SELECT txid, CAST(ceil(weight_units / 4.0) AS BIGINT) AS vsize FROM transactions")
    return out
