"""The eleven summary queries over a window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fee_rate, percent
from ..operators.ledger import Window

TOP = 10


def blocks_and_transactions(w: Window) -> DataFrame:
    """A block without transactions counts 0; a block that comes twice counts its transactions for each row of it."""
    tx = w.transactions.groupBy("block_height").agg(F.count("txid").alias("n"))
    b = w.blocks.groupBy("block_height", "block_hash").agg(F.count(F.lit(1)).alias("copies"))
    return b.join(tx, "block_height", "left").select("block_height", "block_hash", (F.coalesce("n", F.lit(0)) * F.col("copies")).alias("tx_count"))


def fees_by_block(w: Window) -> DataFrame:
    """Ordinary transactions; the mean of the rates, not the rate of the sums."""
    t = w.transactions.where(~F.col("is_coinbase"))
    rate = F.round(F.avg(fee_rate(F.col("fee_sats"), F.col("vsize"))), 3)
    return t.groupBy("block_height").agg(F.sum("fee_sats").alias("total_fees_sats"), rate.alias("avg_fee_rate_sats_per_vbyte"))


def block_weight(w: Window) -> DataFrame:
    return w.blocks.agg(F.round(F.avg("weight_units"), 1).alias("avg_weight_units"), F.max("weight_units").alias("max_weight_units"))


def transaction_sizes(w: Window) -> DataFrame:
    return w.transactions.agg(*[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in ("size_bytes", "weight_units", "vsize")])


def input_output_totals(w: Window) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(w.inputs, "input_count").crossJoin(n(w.outputs, "output_count"))  # one row each


def internal_share(w: Window) -> DataFrame:
    c = w.classified_inputs().agg(F.count(F.lit(1)).alias("total_ordinary_inputs"), F.count_if("internal").alias("internal_count"))
    return c.withColumn("internal_pct", percent(F.col("internal_count"), F.col("total_ordinary_inputs")))


def spent_share(w: Window) -> DataFrame:
    """An output counts once, however many inputs spend it."""
    s, o = w.spent_keys(), w.outputs.select("txid", "output_index")
    joined = o.join(s, (o["txid"] == s["spent_txid"]) & (o["output_index"] == s["spent_index"]), "left")
    c = joined.agg(F.count(F.lit(1)).alias("total_outputs"), F.count("spent_txid").alias("spent_in_window"))
    return c.withColumn("spent_in_window_pct", percent(F.col("spent_in_window"), F.col("total_outputs")))


def script_types(w: Window) -> DataFrame:
    return w.outputs.groupBy("script_type").agg(F.count(F.lit(1)).alias("output_count")).orderBy(F.desc("output_count"), F.col("script_type").asc_nulls_last())


def addressless(w: Window) -> DataFrame:
    c = w.outputs.agg(F.count(F.lit(1)).alias("total_outputs"), F.count_if(F.col("address").isNull()).alias("no_address_count"))
    return c.withColumn("no_address_pct", percent(F.col("no_address_count"), F.col("total_outputs")))


def heaviest(w: Window) -> DataFrame:
    return w.transactions.select("txid", "block_height", "weight_units", "size_bytes", "vsize").orderBy(F.col("weight_units").desc_nulls_last(), "txid").limit(TOP)


def highest_fee_rates(w: Window) -> DataFrame:
    """Ordered by the rounded rate, then by txid."""
    rate = F.round(fee_rate(F.col("fee_sats"), F.col("vsize")), 3)
    t = w.transactions.where(~F.col("is_coinbase")).select("txid", "block_height", "fee_sats", "vsize", rate.alias("fee_rate_sats_per_vbyte"))
    return t.orderBy(F.col("fee_rate_sats_per_vbyte").desc_nulls_last(), "txid").limit(TOP)


SUMMARY: dict[str, Callable[[Window], DataFrame]] = {
    "m01_blocks_and_transactions": blocks_and_transactions,
    "m02_fees_by_block": fees_by_block,
    "m03_block_weight": block_weight,
    "m04_transaction_sizes": transaction_sizes,
    "m05_input_output_totals": input_output_totals,
    "m06_internal_share": internal_share,
    "m07_spent_share": spent_share,
    "m08_script_types": script_types,
    "m09_addressless": addressless,
    "m10_heaviest": heaviest,
    "m11_highest_fee_rates": highest_fee_rates,
}


def show(w: Window) -> None:
    for name, query in SUMMARY.items():
        print(f"== {name[4:].replace('_', ' ')} ({w.start}-{w.end})")
        df = query(w)
        (df.orderBy("block_height") if "block_height" in df.columns and not name.startswith(("m10", "m11")) else df).show(200, truncate=False)
