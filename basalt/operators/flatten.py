"""Nested blocks and transactions to the four flat datasets, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_is_coinbase, vsize
from ..sources.schemas import BLOCKS, INPUTS, OUTPUTS, REQUIRED_BLOCK, REQUIRED_TX, TRANSACTIONS


def missing_block_field() -> Column:
    return F.greatest(*[F.col(c).isNull() for c in REQUIRED_BLOCK])


def missing_tx_field() -> Column:
    """Also true where a prevout has no value."""
    no_value = F.exists("vin", lambda v: v["prevout"].isNotNull() & v["prevout"]["value"].isNull())
    return F.greatest(*[F.col(c).isNull() for c in REQUIRED_TX], F.coalesce(no_value, F.lit(False)))


def blocks(raw: DataFrame) -> DataFrame:
    renamed = raw.select(
        F.col("height").alias("block_height"), F.col("id").alias("block_hash"), F.col("previousblockhash").alias("previous_block_hash"), "timestamp",
        F.col("tx_count").alias("transaction_count"), F.col("size").alias("size_bytes"), F.col("weight").alias("weight_units"), "difficulty", "merkle_root", "nonce", "bits",
    )
    return renamed.select(*BLOCKS.fieldNames())


def transactions(raw: DataFrame) -> DataFrame:
    """raw: nested transactions with block_height, block_hash (the caller's block) and transaction_index."""
    return raw.select(
        "block_height", "block_hash", "txid", F.col("transaction_index").cast("bigint").alias("transaction_index"), "version", "locktime", F.col("size").alias("size_bytes"),
        F.col("weight").alias("weight_units"), vsize(F.col("weight")).alias("vsize"), F.col("fee").alias("fee_sats"), first_is_coinbase(F.col("vin")).alias("is_coinbase"),
    ).select(*TRANSACTIONS.fieldNames())


def inputs(raw: DataFrame) -> DataFrame:
    """A row per element of vin, numbered from 0; none where vin is empty."""
    each = raw.select("block_height", "txid", F.posexplode("vin").alias("input_index", "v"))
    return each.select(
        "block_height", "txid", F.col("input_index").cast("bigint").alias("input_index"), F.col("v.txid").alias("previous_txid"), F.col("v.vout").alias("previous_vout_index"),
        F.col("v.prevout.value").alias("previous_output_value_sats"), F.col("v.prevout.scriptpubkey_address").alias("previous_output_address"),
        F.col("v.prevout.scriptpubkey_type").alias("previous_output_script_type"), F.col("v.scriptsig").alias("scriptsig"), F.col("v.sequence").alias("sequence"),
        F.coalesce("v.is_coinbase", F.lit(False)).alias("is_coinbase"),
    ).select(*INPUTS.fieldNames())


def outputs(raw: DataFrame) -> DataFrame:
    each = raw.select("block_height", "txid", F.posexplode("vout").alias("output_index", "v"))
    return each.select(
        "block_height", "txid", F.col("output_index").cast("bigint").alias("output_index"), F.col("v.value").alias("value_sats"), F.col("v.scriptpubkey_address").alias("address"),
        F.col("v.scriptpubkey_type").alias("script_type"), F.col("v.scriptpubkey").alias("scriptpubkey"),
    ).select(*OUTPUTS.fieldNames())
