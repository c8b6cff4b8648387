"""Declared schemas of raw blocks and of the four datasets, and their natural keys."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, B, D = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RAW_BLOCK = _struct(
    ("id", S), ("height", L), ("previousblockhash", S), ("timestamp", L), ("tx_count", L), ("size", L), ("weight", L), ("difficulty", D), ("merkle_root", S), ("nonce", L), ("bits", L),
)
PREVOUT = _struct(("value", L), ("scriptpubkey_address", S), ("scriptpubkey_type", S))
VIN = _struct(("txid", S), ("vout", L), ("prevout", PREVOUT), ("scriptsig", S), ("sequence", L), ("is_coinbase", B))
VOUT = _struct(("value", L), ("scriptpubkey_address", S), ("scriptpubkey_type", S), ("scriptpubkey", S))
STATUS = _struct(("confirmed", B), ("block_height", L), ("block_hash", S))
RAW_TX = _struct(
    ("txid", S), ("version", L), ("locktime", L), ("size", L), ("weight", L), ("fee", L), ("vin", T.ArrayType(VIN)), ("vout", T.ArrayType(VOUT)), ("status", STATUS),
)

BLOCKS = _struct(
    ("block_height", L), ("block_hash", S), ("previous_block_hash", S), ("timestamp", L), ("transaction_count", L), ("size_bytes", L), ("weight_units", L), ("difficulty", D),
    ("merkle_root", S), ("nonce", L), ("bits", L),
)
TRANSACTIONS = _struct(
    ("block_height", L), ("block_hash", S), ("txid", S), ("transaction_index", L), ("version", L), ("locktime", L), ("size_bytes", L), ("weight_units", L), ("vsize", L), ("fee_sats", L),
    ("is_coinbase", B),
)
INPUTS = _struct(
    ("block_height", L), ("txid", S), ("input_index", L), ("previous_txid", S), ("previous_vout_index", L), ("previous_output_value_sats", L), ("previous_output_address", S),
    ("previous_output_script_type", S), ("scriptsig", S), ("sequence", L), ("is_coinbase", B),
)
OUTPUTS = _struct(("block_height", L), ("txid", S), ("output_index", L), ("value_sats", L), ("address", S), ("script_type", S), ("scriptpubkey", S))

DATASETS = {"blocks": BLOCKS, "transactions": TRANSACTIONS, "inputs": INPUTS, "outputs": OUTPUTS}
KEYS = {
    "blocks": ["block_height", "block_hash"],
    "transactions": ["txid"],
    "inputs": ["txid", "input_index"],
    "outputs": ["txid", "output_index"],
}
#: Raw fields that must be there; a height that lacks one fails as a whole.
REQUIRED_BLOCK = ["height", "id", "timestamp", "tx_count", "size", "weight", "difficulty", "merkle_root", "nonce", "bits"]
REQUIRED_TX = ["txid", "version", "locktime", "size", "weight", "vin", "vout"]


def empty_like(spark, name: str):
    return spark.createDataFrame([], DATASETS[name])
