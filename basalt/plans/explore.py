"""The fourteen exploration queries over raw nested blocks and transactions, without a window.

Flags are as in the raw data: a transaction whose first input has no flag is neither coinbase nor ordinary here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import vsize


@dataclass(frozen=True)
class Raw:
    blocks: DataFrame
    transactions: DataFrame


def _flag() -> Column:
    return F.get("vin", F.lit(0))["is_coinbase"]


def _ordinary(r: Raw) -> DataFrame:
    return r.transactions.where(~_flag())


def block_summary(r: Raw) -> DataFrame:
    return r.blocks.select("height", F.col("id").alias("block_hash"), "tx_count", "size", "weight", F.timestamp_seconds("timestamp").alias("block_time")).orderBy("height")


def completeness(r: Raw) -> DataFrame:
    """A transaction belongs to the block whose hash its status names."""
    t = r.transactions.groupBy(F.col("status.block_hash").alias("h")).agg(F.count("txid").alias("n"))
    b = r.blocks.groupBy("height", "tx_count", "id").agg(F.count(F.lit(1)).alias("copies"))
    joined = b.join(t, b["id"] == t["h"], "left").groupBy("height", "tx_count").agg(F.sum(F.coalesce("n", F.lit(0)) * F.col("copies")).alias("fetched_tx_count"))
    return joined.select("height", F.col("tx_count").alias("reported_tx_count"), "fetched_tx_count").orderBy("height")


def coinbase(r: Raw) -> DataFrame:
    return r.transactions.where(_flag()).select("txid", "fee", F.size("vin").cast("bigint").alias("num_inputs"), F.size("vout").cast("bigint").alias("num_outputs"), F.get("vout", F.lit(0))["value"].alias("first_output_value_sats"))


def fee_distribution(r: Raw) -> DataFrame:
    return _ordinary(r).agg(F.count(F.lit(1)).alias("num_txs"), F.min("fee").alias("min_fee_sats"), F.round(F.avg("fee"), 1).alias("avg_fee_sats"), F.max("fee").alias("max_fee_sats"), F.sum("fee").alias("total_fees_sats"))


def sample(r: Raw) -> DataFrame:
    """The first ordinary transaction of several inputs, by height and txid; no row where there is none."""
    return _ordinary(r).where(F.size("vin") > 1).orderBy("status.block_height", "txid").select("txid").limit(1)


def _of_sample(r: Raw) -> DataFrame:
    return r.transactions.join(F.broadcast(sample(r)), "txid", "left_semi")  # one row


def sample_inputs(r: Raw) -> DataFrame:
    each = _of_sample(r).select(F.posexplode("vin").alias("i", "v"))
    return each.select((F.col("i") + 1).cast("bigint").alias("idx"), F.col("v.prevout.value").alias("value_sats"), F.col("v.prevout.scriptpubkey_address").alias("address")).orderBy("idx")


def sample_outputs(r: Raw) -> DataFrame:
    each = _of_sample(r).select(F.posexplode("vout").alias("i", "v"))
    return each.select((F.col("i") + 1).cast("bigint").alias("idx"), F.col("v.value").alias("value_sats"), F.col("v.scriptpubkey_address").alias("address")).orderBy("idx")


def chain(r: Raw) -> DataFrame:
    """Against the block loaded before, whatever its height. One row a block: a single partition is no matter."""
    prior = F.lag("id").over(W.orderBy("height"))
    b = r.blocks.select("height", F.col("id").alias("block_hash"), "previousblockhash", prior.alias("prior_block_hash_in_window"))
    return b.withColumn("linked_to_prior", F.col("previousblockhash") == F.col("prior_block_hash_in_window"))


def by_block(r: Raw) -> DataFrame:
    t = r.transactions.select(F.col("status.block_height").alias("height"), "fee", (~_flag()).alias("ordinary"))
    fee = F.when(F.col("ordinary"), F.col("fee"))
    return t.groupBy("height").agg(F.count(F.lit(1)).alias("tx_count"), F.count_if("ordinary").alias("ordinary_tx_count"), F.sum(fee).alias("total_fees_sats"), F.round(F.avg(fee), 1).alias("avg_fee_sats"))


def block_sizes(r: Raw) -> DataFrame:
    return r.blocks.agg(*[f for c in ("weight", "size") for f in (F.round(F.avg(c), 1).alias(f"avg_{c}_{'units' if c == 'weight' else 'bytes'}"), F.max(c).alias(f"max_{c}_{'units' if c == 'weight' else 'bytes'}"))])


def transaction_sizes(r: Raw) -> DataFrame:
    return r.transactions.agg(F.round(F.avg("size"), 1).alias("avg_size_bytes"), F.round(F.avg("weight"), 1).alias("avg_weight_units"), F.round(F.avg(vsize(F.col("weight"))), 1).alias("avg_vsize"))


def in_out_counts(r: Raw) -> DataFrame:
    aggs = []
    for c, n in (("vin", "inputs"), ("vout", "outputs")):
        k = F.size(c).cast("bigint")
        aggs += [F.min(k).alias(f"min_{n}"), F.round(F.avg(k), 2).alias(f"avg_{n}"), F.max(k).alias(f"max_{n}")]
    return _ordinary(r).agg(*aggs)


def foreign_inputs(r: Raw) -> DataFrame:
    """Ordinary inputs, and those of them whose previous transaction is not loaded (or null)."""
    i = r.transactions.select(F.explode("vin").alias("v")).select(F.col("v.txid").alias("previous_txid"), F.col("v.is_coinbase").alias("is_coinbase")).where(~F.col("is_coinbase"))
    known = r.transactions.select(F.col("txid").alias("known")).distinct()
    return i.join(known, F.col("previous_txid") == F.col("known"), "left").agg(F.count(F.lit(1)).alias("ordinary_input_count"), F.count_if(F.col("known").isNull()).alias("foreign_input_count"))


def spent_outputs(r: Raw) -> DataFrame:
    o = r.transactions.select("txid", F.posexplode("vout").alias("output_index", "v")).select("txid", F.col("output_index").cast("bigint").alias("output_index"))
    i = r.transactions.select(F.explode("vin").alias("v")).where(~F.col("v.is_coinbase")).select(F.col("v.txid").alias("s_txid"), F.col("v.vout").alias("s_index")).distinct()
    joined = o.join(i, (o["txid"] == i["s_txid"]) & (o["output_index"] == i["s_index"]), "left")
    return joined.agg(F.count(F.lit(1)).alias("outputs_created_in_window"), F.count("s_txid").alias("outputs_also_spent_in_window"))


EXPLORE: dict[str, Callable[[Raw], DataFrame]] = {
    "e01_block_summary": block_summary,
    "e02_completeness": completeness,
    "e03_coinbase": coinbase,
    "e04_fee_distribution": fee_distribution,
    "e05_sample": sample,
    "e06_sample_inputs": sample_inputs,
    "e07_sample_outputs": sample_outputs,
    "e08_chain": chain,
    "e09_by_block": by_block,
    "e10_block_sizes": block_sizes,
    "e11_transaction_sizes": transaction_sizes,
    "e12_in_out_counts": in_out_counts,
    "e13_foreign_inputs": foreign_inputs,
    "e14_spent_outputs": spent_outputs,
}


def show(r: Raw) -> None:
    for name, query in EXPLORE.items():
        print(f"== {name[4:].replace('_', ' ')}")
        query(r).show(200, truncate=False)
