"""The four datasets together, and a window of heights over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ledger:
    blocks: DataFrame
    transactions: DataFrame
    inputs: DataFrame
    outputs: DataFrame

    def window(self, start: int, end: int) -> Window:
        return Window(self, start, end)


class Window:
    """Heights start to end, both included. The filter on block_height prunes partitions; `all_blocks` is not filtered, as
    some checks look at blocks beyond the window."""

    def __init__(self, ledger: Ledger, start: int, end: int):
        self.start, self.end = start, end
        inside = lambda df: df.where(F.col("block_height").between(start, end))
        self.all_blocks = ledger.blocks
        self.blocks, self.transactions, self.inputs, self.outputs = (inside(x) for x in (ledger.blocks, ledger.transactions, ledger.inputs, ledger.outputs))

    @property
    def ordinary_inputs(self) -> DataFrame:
        """Coinbase inputs all name one previous transaction of zeros: they are dropped before any join on it."""
        return self.inputs.where(~F.col("is_coinbase"))

    @property
    def txids(self) -> DataFrame:
        return self.transactions.select("txid").distinct()

    def classified_inputs(self) -> DataFrame:
        """Ordinary inputs with internal: whether their previous transaction is in the window (not, where it is null)."""
        known = self.txids.select(F.col("txid").alias("known_txid"))
        i = self.ordinary_inputs
        return i.join(known, i["previous_txid"] == known["known_txid"], "left").withColumn("internal", F.col("known_txid").isNotNull()).drop("known_txid")

    def spent_keys(self) -> DataFrame:
        """Outputs that ordinary inputs of the window name, once each."""
        return self.ordinary_inputs.select(F.col("previous_txid").alias("spent_txid"), F.col("previous_vout_index").alias("spent_index")).distinct()
