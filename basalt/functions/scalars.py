"""Column functions of the ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vsize(weight: Column) -> Column:
    """A quarter of the weight, rounded up. Division by an integer keeps doubles; by 4.0 it would be decimal."""
    return F.ceil(weight / F.lit(4))


def first_is_coinbase(vin: Column) -> Column:
    """The first input's flag; false where there is no input or no flag."""
    return F.coalesce(F.get(vin, F.lit(0))["is_coinbase"], F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; null where whole is 0."""
    return F.round(F.try_divide(F.lit(100.0).cast("double") * part, whole.cast("double")), 2)


def percent_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(percent(part, whole), F.lit(0.0))


def fee_rate(fee: Column, size: Column) -> Column:
    return F.try_divide(fee.cast("double"), size.cast("double"))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Without time zone; sessions are in UTC."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def surrogate(*parts: Column) -> Column:
    """Parts with '-' between; null if one is (concat_ws would skip it)."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit("-"), p.cast("string")]
    return F.concat(*out[1:])
