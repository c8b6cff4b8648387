"""A ledger out of a star schema: orders as transactions, line items as outputs, months as blocks.

A customer's order spends outputs of that customer's order before it. `dirty` breaks, by the order's number, at least one row for every
check of the gate. Everything is derived by rule, so the same tables give the same ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import vsize
from ..operators.ledger import Ledger
from ..sources.schemas import BLOCKS, INPUTS, OUTPUTS, TRANSACTIONS
from .explore import Raw

FIRST_YEAR, GENESIS_TIME, BLOCK_SECONDS = 1995, 788918400, 2629800
FOREIGN_VALUE, COINBASE_INDEX, COINBASE_TXID = 10_000_000, 4294967295, "0" * 64
SPENDABLE = 3


def _hash(height: Column) -> Column:
    return F.md5(F.concat(F.lit("b"), height.cast("string")))


def _rest(key: Column, a: int, r: int) -> Column:
    return F.coalesce(key % a == r, F.lit(False))


def _key(txid: str = "txid") -> Column:
    """The order's number; null for a txid that is none. A failing cast could be moved below the join it depends on."""
    return F.expr(f"try_cast({txid} as bigint)")


def clean(orders: DataFrame, lineitem: DataFrame) -> Ledger:
    date = F.col("o_orderdate")
    height = ((F.year(date) - FIRST_YEAR) * 12 + F.month(date) - 1).cast("bigint")
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), date.alias("date"), height.alias("block_height"))
    in_block, of_customer = W.partitionBy("block_height").orderBy("date", "k"), W.partitionBy("cust").orderBy("date", "k")
    o = o.withColumn("transaction_index", (F.row_number().over(in_block) - 1).cast("bigint")).withColumn("prior", F.lag("k").over(of_customer))
    o = o.withColumn("txid", F.col("k").cast("string")).withColumn("is_coinbase", F.col("transaction_index") == 0)

    flag = F.min("l_returnflag")
    lines = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("value_sats"),
        F.when(flag != "N", F.concat(F.lit("addr"), F.min("l_partkey").cast("string"))).alias("address"),
        F.when(flag == "N", "op_return").when(flag == "A", "v0_p2wpkh").otherwise("p2sh").alias("script_type"),
    )
    lines = lines.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("bigint") - 1).alias("output_index"), "value_sats", "address", "script_type")
    outputs = o.select("k", "block_height", "txid").join(lines, "k").withColumn("scriptpubkey", F.md5(F.concat("txid", F.lit(":"), F.col("output_index").cast("string"))))

    spent = lines.where(F.col("output_index") < SPENDABLE).withColumnRenamed("k", "prior")
    ordinary = o.where(~F.col("is_coinbase"))
    position = (F.row_number().over(W.partitionBy("k").orderBy("output_index")) - 1).cast("bigint")
    internal = ordinary.where("prior is not null").join(spent, "prior").select(
        "block_height", "txid", "k", position.alias("input_index"), F.col("prior").cast("string").alias("previous_txid"), F.col("output_index").alias("previous_vout_index"),
        F.col("value_sats").alias("previous_output_value_sats"), F.col("address").alias("previous_output_address"), F.col("script_type").alias("previous_output_script_type"), F.lit(False).alias("is_coinbase"),
    )
    single = lambda df, txid, index, value, flag: df.select(
        "block_height", "txid", "k", F.lit(0).cast("bigint").alias("input_index"), txid.alias("previous_txid"), F.lit(index).cast("bigint").alias("previous_vout_index"),
        F.lit(value).cast("bigint").alias("previous_output_value_sats"), F.lit(None).cast("string").alias("previous_output_address"), F.lit(None).cast("string").alias("previous_output_script_type"), F.lit(flag).alias("is_coinbase"),
    )
    inputs = internal.unionByName(single(ordinary.where("prior is null"), F.concat(F.lit("ext"), F.col("cust").cast("string")), 0, FOREIGN_VALUE, False))
    inputs = inputs.unionByName(single(o.where("is_coinbase"), F.lit(COINBASE_TXID), COINBASE_INDEX, None, True))
    inputs = inputs.withColumn("scriptsig", F.md5(F.concat(F.lit("s"), "txid"))).withColumn("sequence", F.lit(COINBASE_INDEX).cast("bigint") - F.col("input_index"))

    total_in = inputs.groupBy("k").agg(F.sum("previous_output_value_sats").alias("total_in"))
    total_out = lines.groupBy("k").agg(F.sum("value_sats").alias("total_out"))
    size = F.lit(200) + F.col("k") % 800
    fee = F.coalesce("total_in", F.lit(0)) - F.coalesce("total_out", F.lit(0)) + F.when(_rest(F.col("k"), 997, 3), 1).otherwise(0)
    t = o.join(total_in, "k", "left").join(total_out, "k", "left").withColumn("size_bytes", size.cast("bigint"))
    t = t.withColumn("weight_units", (4 * F.col("size_bytes") - 3 * (F.col("k") % 150)).cast("bigint"))
    t = t.select(
        "block_height", _hash(F.col("block_height")).alias("block_hash"), "txid", "transaction_index", F.lit(2).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("locktime"), "size_bytes", "weight_units",
        (vsize(F.col("weight_units")) + F.when(_rest(F.col("k"), 4999, 7), 1).otherwise(0)).cast("bigint").alias("vsize"), F.when(F.col("is_coinbase"), 0).otherwise(fee).cast("bigint").alias("fee_sats"), "is_coinbase",
    )

    b = t.groupBy("block_height").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size_bytes"), F.sum("weight_units").alias("weight_units"))
    h = F.col("block_height")
    b = b.select(
        "block_height", _hash(h).alias("block_hash"), F.when(h % 31 == 30, F.md5(F.concat(F.lit("broken"), h.cast("string")))).otherwise(_hash(h - 1)).alias("previous_block_hash"),
        (F.lit(GENESIS_TIME) + F.lit(BLOCK_SECONDS) * h).cast("bigint").alias("timestamp"), (F.col("n") + F.when(h % 37 == 36, 1).otherwise(0)).cast("bigint").alias("transaction_count"), "size_bytes", "weight_units",
        (h + 1).cast("double").alias("difficulty"), F.md5(F.concat(F.lit("m"), h.cast("string"))).alias("merkle_root"), (h * 7919).alias("nonce"), (h + 386000000).alias("bits"),
    )
    return Ledger(b.select(*BLOCKS.fieldNames()), t.select(*TRANSACTIONS.fieldNames()), inputs.select(*INPUTS.fieldNames()), outputs.select(*OUTPUTS.fieldNames()))


def dirty(c: Ledger) -> Ledger:
    k = _key()
    alter = lambda df, col, cond, value: df.withColumn(col, F.when(cond, value).otherwise(F.col(col)))
    twice = lambda df, cond: df.unionByName(df.where(cond))
    blocks = twice(c.blocks.where("block_height <> 40"), F.col("block_height") == 44)
    t = twice(c.transactions, _rest(k, 3001, 9))
    t = alter(t, "is_coinbase", _rest(k, 2503, 11), F.lit(True))
    t = alter(t, "block_hash", _rest(k, 1999, 5), F.lit("bad"))
    t = alter(t, "transaction_index", _rest(k, 2801, 4), F.lit(-1).cast("bigint"))
    t = alter(t, "size_bytes", _rest(k, 2513, 17), F.lit(0).cast("bigint"))
    t = alter(t, "weight_units", _rest(k, 2617, 18), F.lit(0).cast("bigint"))
    i = twice(c.inputs, _rest(k, 2707, 8))
    i = alter(i, "is_coinbase", _rest(k, 2503, 11) | _rest(k, 2203, 6), F.lit(True))
    i = alter(i, "previous_txid", _rest(k, 1801, 10), F.lit(None).cast("string"))
    i = alter(i, "previous_output_value_sats", _rest(k, 1901, 12), F.lit(-5).cast("bigint"))
    i = i.withColumn("previous_vout_index", F.col("previous_vout_index") + F.when(_rest(k, 1301, 13), 50).otherwise(0))
    o = twice(c.outputs, _rest(k, 2909, 14))
    o = alter(o, "value_sats", _rest(k, 2311, 15) & (F.col("output_index") < SPENDABLE), F.lit(-1).cast("bigint"))
    o = o.unionByName(c.outputs.where(_rest(k, 2411, 16)).withColumn("txid", F.concat(F.lit("orphan"), "txid")))
    return Ledger(blocks, t, i.select(*INPUTS.fieldNames()), o)


def nested(c: Ledger) -> Raw:
    """Raw nested blocks and transactions of the same ledger."""
    blocks = c.blocks.select(
        F.col("block_hash").alias("id"), F.col("block_height").alias("height"), F.col("previous_block_hash").alias("previousblockhash"), "timestamp", F.col("transaction_count").alias("tx_count"),
        F.col("size_bytes").alias("size"), F.col("weight_units").alias("weight"), "difficulty", "merkle_root", "nonce", "bits",
    )
    prevout = F.when(~F.col("is_coinbase"), F.struct(F.col("previous_output_value_sats").alias("value"), F.col("previous_output_address").alias("scriptpubkey_address"), F.col("previous_output_script_type").alias("scriptpubkey_type")))
    vin = F.struct("input_index", F.struct(F.col("previous_txid").alias("txid"), F.col("previous_vout_index").alias("vout"), prevout.alias("prevout"), "scriptsig", "sequence", "is_coinbase").alias("v"))
    vout = F.struct("output_index", F.struct(F.col("value_sats").alias("value"), F.col("address").alias("scriptpubkey_address"), F.col("script_type").alias("scriptpubkey_type"), "scriptpubkey").alias("v"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda e: e["v"])
    i, o = c.inputs.groupBy("txid").agg(ordered(vin).alias("vin")), c.outputs.groupBy("txid").agg(ordered(vout).alias("vout"))
    t = c.transactions.join(i, "txid", "left").join(o, "txid", "left")
    t = t.select(
        "txid", "version", "locktime", F.col("size_bytes").alias("size"), F.col("weight_units").alias("weight"), F.col("fee_sats").alias("fee"), F.coalesce("vin", F.expr("array()")).alias("vin"), F.coalesce("vout", F.expr("array()")).alias("vout"),
        F.struct(F.lit(True).alias("confirmed"), "block_height", "block_hash").alias("status"), "transaction_index",
    )
    return Raw(blocks, t)


_held: dict[tuple, Ledger | Raw] = {}


def ledger_of(spark: SparkSession, sf_dir: str, kind: str = "clean") -> Ledger:
    """The ledger of a folder of tables, kept in memory and on disk while the session lasts, as all queries use it."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _held:
        if kind == "clean":
            l = clean(spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"))  # noqa: E741
        else:
            l = dirty(ledger_of(spark, sf_dir))  # noqa: E741
        _held[at] = Ledger(l.blocks.persist(), l.transactions.persist(), l.inputs.persist(), l.outputs.persist())
    return _held[at]


def raw_of(spark: SparkSession, sf_dir: str) -> Raw:
    at = (spark.sparkContext.applicationId, sf_dir, "raw")
    if at not in _held:
        r = nested(ledger_of(spark, sf_dir))
        _held[at] = Raw(r.blocks, r.transactions.persist())
    return _held[at]
