"""The 33 checks of the data-quality gate.

Each check is a query over a window that gives its violating rows, all of them. Checks of single rows are predicates, so that one
pass over a dataset counts all of them; the others group or join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent_or_zero
from .ledger import Window

FAIL, WARN, BOUNDARY, PASS = "FAIL", "WARN", "EXPECTED_BOUNDARY", "PASS"


@dataclass(frozen=True)
class Check:
    number: int
    id: str
    category: str
    severity: str
    description: str
    rows: Callable[[Window], DataFrame]
    order: tuple[str, ...]
    capped: bool = False
    dataset: str | None = None
    predicate: str | None = None

    @property
    def name(self) -> str:
        return f"g{self.number:02d}_{self.id}"


def _local(number: int, id: str, category: str, severity: str, description: str, dataset: str, predicate: str, columns: list[str], order: tuple[str, ...]) -> Check:
    return Check(number, id, category, severity, description, lambda w: getattr(w, dataset).where(predicate).select(*columns), order, True, dataset, predicate)


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def missing_heights(w: Window) -> DataFrame:
    expected = w.blocks.sparkSession.range(w.start, w.end + 1).select(F.col("id").alias("missing_height"))
    return expected.join(w.blocks.select("block_height"), F.col("missing_height") == F.col("block_height"), "left_anti")


def transaction_counts(w: Window) -> DataFrame:
    """A block's row that comes twice doubles its count, as the join keeps both."""
    tx = w.transactions.groupBy("block_height").agg(F.count("txid").alias("n"))
    per = w.blocks.groupBy("block_height", F.col("transaction_count").alias("reported")).agg(F.count(F.lit(1)).alias("copies"))
    joined = per.join(tx, "block_height", "left")
    return joined.select("block_height", "reported", (F.coalesce("n", F.lit(0)) * F.col("copies")).alias("actual")).where("actual <> reported")


def coinbase_counts(w: Window) -> DataFrame:
    return w.transactions.groupBy("block_height").agg(F.count_if("is_coinbase").alias("coinbase_count")).where("coinbase_count <> 1")


def hash_agreement(w: Window) -> DataFrame:
    b = w.all_blocks.select("block_height", F.col("block_hash").alias("blocks_table_hash"))
    t = w.transactions.select("txid", "block_height", F.col("block_hash").alias("tx_block_hash"))
    return t.join(b, "block_height").where("tx_block_hash <> blocks_table_hash").select("txid", "block_height", "tx_block_hash", "blocks_table_hash")


def chain_links(w: Window) -> DataFrame:
    b = w.blocks.where(F.col("block_height") > w.start).select("block_height", "previous_block_hash")
    prior = w.all_blocks.select((F.col("block_height") + 1).alias("h"), F.col("block_hash").alias("expected_prior_hash"))
    return b.join(prior, b["block_height"] == prior["h"], "left").where("expected_prior_hash is null or previous_block_hash <> expected_prior_hash").drop("h")


def first_predecessor(w: Window) -> DataFrame:
    return w.blocks.where(F.col("block_height") == w.start).select("block_height", "previous_block_hash").orderBy("previous_block_hash").limit(1)


def blockless_transactions(w: Window) -> DataFrame:
    return w.transactions.select("txid", "block_height").join(w.all_blocks.select("block_height"), "block_height", "left_anti").select("txid", "block_height")


def incomplete_transactions(w: Window) -> DataFrame:
    """txid and what it misses: 'input', 'output'; a transaction without either comes twice."""
    t = w.txids
    part = lambda df, what: t.join(df.select("txid"), "txid", "left_anti").select("txid", F.lit(what).alias("missing"))
    return part(w.inputs, "input").union(part(w.outputs, "output"))


def coinbase_inputs_of_ordinary(w: Window) -> DataFrame:
    t = w.transactions.where(~F.col("is_coinbase")).select("txid")
    return t.join(w.inputs.where("is_coinbase").select("txid"), "txid", "left_semi").distinct()


def foreign_summary(w: Window) -> DataFrame:
    c = w.classified_inputs().agg(F.count(F.lit(1)).alias("total_ordinary_inputs"), F.count_if("internal").alias("internal_count"), F.count_if(~F.col("internal")).alias("foreign_count"))
    return c.withColumn("foreign_pct", percent_or_zero(F.col("foreign_count"), F.col("total_ordinary_inputs")))


def foreign_samples(w: Window) -> DataFrame:
    return w.classified_inputs().where("not internal").select("txid", "input_index", "previous_txid")


def unresolved_inputs(w: Window) -> DataFrame:
    i = w.classified_inputs().where("internal").select("txid", "input_index", "previous_txid", "previous_vout_index")
    o = w.outputs.groupBy(F.col("txid").alias("o_txid"), F.col("output_index").alias("o_index")).agg(F.count("output_index").alias("n"))
    joined = i.join(o, (i["previous_txid"] == o["o_txid"]) & (i["previous_vout_index"] == o["o_index"]), "left")
    # Equal inputs are one group, in which each counts its own matches.
    return joined.groupBy("txid", "input_index", "previous_txid", "previous_vout_index").agg(F.sum(F.coalesce("n", F.lit(0))).alias("matching_outputs")).where("matching_outputs <> 1")


def address_summary(w: Window) -> DataFrame:
    c = w.outputs.agg(F.count(F.lit(1)).alias("total_outputs"), F.count_if(F.col("address").isNull()).alias("no_address_count"))
    return c.withColumn("no_address_pct", percent_or_zero(F.col("no_address_count"), F.col("total_outputs")))


def address_samples(w: Window) -> DataFrame:
    return w.outputs.where("address is null").select("txid", "output_index", "script_type")


def orphan_outputs(w: Window) -> DataFrame:
    return w.outputs.select("txid", "output_index").join(w.txids, "txid", "left_anti").select("txid", "output_index")


def input_sums(w: Window) -> DataFrame:
    return w.ordinary_inputs.groupBy("txid").agg(F.sum("previous_output_value_sats").alias("total_in"), F.count_if(F.col("previous_output_value_sats").isNull()).alias("unknown"))


def fee_summary(w: Window) -> DataFrame:
    """Only ordinary transactions with an ordinary input count."""
    t = w.transactions.where(~F.col("is_coinbase")).select("txid").join(input_sums(w), "txid")
    return t.agg(F.count(F.lit(1)).alias("total_ordinary_transactions"), F.count_if(F.col("unknown") == 0).alias("checkable_transactions"))


def fee_mismatches(w: Window) -> DataFrame:
    spent = input_sums(w).where("unknown = 0").select("txid", "total_in")
    made = w.outputs.groupBy("txid").agg(F.sum("value_sats").alias("total_out"))
    t = w.transactions.where(~F.col("is_coinbase")).select("txid", F.col("fee_sats").alias("reported_fee"))
    joined = t.join(spent, "txid").join(made, "txid")
    return joined.select("txid", "reported_fee", (F.col("total_in") - F.col("total_out")).alias("derived_fee")).where("derived_fee <> reported_fee")


def unspent_summary(w: Window) -> DataFrame:
    """An output that several inputs spend counts once for each of them."""
    spent = w.ordinary_inputs.groupBy(F.col("previous_txid").alias("s_txid"), F.col("previous_vout_index").alias("s_index")).agg(F.count(F.lit(1)).alias("spends"))
    o = w.outputs.select("txid", "output_index")
    joined = o.join(spent, (o["txid"] == spent["s_txid"]) & (o["output_index"] == spent["s_index"]), "left")
    c = joined.agg(F.coalesce(F.sum(F.coalesce("spends", F.lit(1))), F.lit(0)).alias("total_outputs"), F.count_if(F.col("spends").isNull()).alias("unspent_in_window_count"))
    return c.withColumn("unspent_in_window_pct", percent_or_zero(F.col("unspent_in_window_count"), F.col("total_outputs")))


BC, CL, TI, II, OI, MC, SW, WB = (
    "block_completeness", "chain_linkage", "transaction_integrity", "input_integrity", "output_integrity", "monetary_consistency", "size_weight_vsize", "window_boundary",
)

CHECKS: list[Check] = [
    Check(1, "heights_present_exactly_once", BC, FAIL, "Every height asked for has a block.", missing_heights, ("missing_height",)),
    Check(2, "no_duplicate_block_heights", BC, FAIL, "No height has two blocks.", lambda w: _repeated(w.blocks, "block_height"), ("block_height",)),
    Check(3, "no_duplicate_block_hashes", BC, FAIL, "No hash has two blocks.", lambda w: _repeated(w.blocks, "block_hash"), ("block_hash",)),
    Check(4, "block_tx_count_matches_transactions", BC, FAIL, "Blocks have as many transactions as they report.", transaction_counts, ("block_height",)),
    Check(5, "exactly_one_coinbase_per_block", BC, FAIL, "Blocks with transactions have one coinbase transaction.", coinbase_counts, ("block_height",)),
    Check(6, "block_height_hash_agree_with_transactions", BC, FAIL, "Transactions have their block's hash.", hash_agreement, ("txid",), True),
    Check(7, "chain_linkage_internal", CL, FAIL, "Blocks after the first name the hash of the block before.", chain_links, ("block_height",)),
    Check(8, "first_block_predecessor_unverifiable", CL, BOUNDARY, "The first block's predecessor is outside the window.", first_predecessor, ("block_height",)),
    Check(9, "txid_unique", TI, FAIL, "No two transactions have one txid.", lambda w: _repeated(w.transactions, "txid"), ("txid",), True),
    Check(10, "transactions_reference_loaded_block", TI, FAIL, "Transactions' heights have a block.", blockless_transactions, ("txid",), True),
    _local(11, "transaction_index_nonnegative", TI, FAIL, "Positions are not negative.", "transactions", "transaction_index < 0", ["txid", "block_height", "transaction_index"], ("txid",)),
    Check(12, "transaction_index_unique_per_block", TI, FAIL, "No two transactions of a block have one position.", lambda w: _repeated(w.transactions, "block_height", "transaction_index"), ("block_height", "transaction_index"), True),
    Check(13, "each_transaction_has_input_and_output", TI, FAIL, "Transactions have inputs and outputs.", incomplete_transactions, ("missing", "txid")),
    _local(14, "coinbase_is_first_transaction_in_block", TI, WARN, "Coinbase transactions come first.", "transactions", "is_coinbase and transaction_index <> 0", ["block_height", "txid", "transaction_index"], ("block_height", "txid")),
    Check(15, "ordinary_transactions_no_coinbase_input", TI, FAIL, "Ordinary transactions have no coinbase input.", coinbase_inputs_of_ordinary, ("txid",), True),
    Check(16, "input_index_unique_per_transaction", II, FAIL, "No two inputs of a transaction have one position.", lambda w: _repeated(w.inputs, "txid", "input_index"), ("txid", "input_index"), True),
    _local(17, "ordinary_inputs_have_previous_reference", II, FAIL, "Ordinary inputs name what they spend.", "inputs", "not is_coinbase and (previous_txid is null or previous_vout_index is null)", ["txid", "input_index"], ("txid", "input_index")),
    _local(18, "coinbase_inputs_have_no_previous_output", II, WARN, "Coinbase inputs have no spent value.", "inputs", "is_coinbase and previous_output_value_sats is not null", ["txid", "input_index", "previous_output_value_sats"], ("txid", "input_index")),
    _local(19, "previous_output_value_nonnegative", II, FAIL, "Spent values are not negative.", "inputs", "previous_output_value_sats < 0", ["txid", "input_index", "previous_output_value_sats"], ("txid", "input_index")),
    Check(20, "foreign_input_references", II, BOUNDARY, "Ordinary inputs that spend from outside the window.", foreign_summary, ("total_ordinary_inputs",)),
    Check(21, "internal_input_references_resolve_uniquely", II, FAIL, "Ordinary inputs that spend inside the window name one output.", unresolved_inputs, ("txid", "input_index"), True),
    Check(22, "output_index_unique_per_transaction", OI, FAIL, "No two outputs of a transaction have one position.", lambda w: _repeated(w.outputs, "txid", "output_index"), ("txid", "output_index"), True),
    _local(23, "output_value_nonnegative", OI, FAIL, "Values are not negative.", "outputs", "value_sats < 0", ["txid", "output_index", "value_sats"], ("txid", "output_index")),
    Check(24, "outputs_without_standard_address", OI, BOUNDARY, "Outputs whose script has no address.", address_summary, ("total_outputs",)),
    Check(25, "outputs_reference_valid_loaded_transaction", OI, FAIL, "Outputs belong to a transaction of the window.", orphan_outputs, ("txid", "output_index"), True),
    Check(26, "fee_arithmetic_matches", MC, FAIL, "Fees are inputs less outputs where all inputs' values are known.", fee_mismatches, ("txid",), True),
    _local(27, "fees_nonnegative", MC, FAIL, "Ordinary fees are not negative.", "transactions", "not is_coinbase and fee_sats < 0", ["txid", "fee_sats"], ("txid",)),
    _local(28, "coinbase_fee_is_zero", MC, WARN, "Coinbase transactions pay no fee.", "transactions", "is_coinbase and fee_sats <> 0", ["txid", "fee_sats"], ("txid",)),
    _local(29, "size_positive", SW, FAIL, "Sizes are positive.", "transactions", "size_bytes <= 0", ["txid", "size_bytes"], ("txid",)),
    _local(30, "weight_positive", SW, FAIL, "Weights are positive.", "transactions", "weight_units <= 0", ["txid", "weight_units"], ("txid",)),
    _local(31, "vsize_matches_formula", SW, FAIL, "vsize is a quarter of the weight, rounded up.", "transactions", "vsize <> ceil(weight_units / 4)", ["txid", "weight_units", "vsize"], ("txid",)),
    _local(32, "weight_not_greater_than_four_times_size", SW, FAIL, "Weights are at most four times sizes.", "transactions", "weight_units > 4 * size_bytes", ["txid", "size_bytes", "weight_units"], ("txid",)),
    Check(33, "outputs_unspent_within_window", WB, BOUNDARY, "Outputs that no input of the window spends.", unspent_summary, ("total_outputs",)),
]


def size_summary(w: Window) -> DataFrame:
    """Least, mean and most of size, weight and vsize."""
    aggs = []
    for name, c in (("size", "size_bytes"), ("weight", "weight_units"), ("vsize", "vsize")):
        aggs += [F.min(c).alias(f"min_{name}"), F.round(F.avg(c), 1).alias(f"avg_{name}"), F.max(c).alias(f"max_{name}")]
    return w.transactions.agg(*aggs)
