"""The gate: all checks over a window, and the report.

Checks of single rows are counted in one pass over each dataset, those that compare a transaction with its inputs and outputs behind one
shuffle by txid, those that compare it with its block on counts by height and hash; the few others are counted by a query each, all in
one job. Rows are fetched only for checks that found some, SAMPLES at most.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.checks import BOUNDARY, CHECKS, FAIL, PASS, WARN, Check, address_samples, fee_summary, foreign_samples, size_summary
from ..operators.ledger import Window

SAMPLES = 10


def _pairs(sums: DataFrame, numbers: list[int]) -> DataFrame:
    """check_number and violations out of one row that has a column c<number> for each check."""
    pairs = [F.struct(F.lit(n).alias("check_number"), F.coalesce(F.col(f"c{n}").cast("bigint"), F.lit(0)).alias("violations")) for n in numbers]
    return sums.select(F.inline(F.array(*pairs)))


def _by_txid(w: Window) -> DataFrame:
    """Checks of a transaction against its inputs and outputs: all three datasets, in narrow rows, are shuffled once by txid.

    A mark is an input's or output's position, and a transaction's fee. A null txid equals no other, so its rows have no partner."""
    part = lambda df, kind, mark, coinbase, sats: df.select("txid", F.lit(kind).alias("kind"), F.col(mark).cast("bigint").alias("mark"), coinbase.alias("coinbase"), sats.cast("bigint").alias("sats"))
    rows = part(w.inputs, "i", "input_index", F.col("is_coinbase"), F.col("previous_output_value_sats"))
    rows = rows.union(part(w.outputs, "o", "output_index", F.lit(None).cast("boolean"), F.col("value_sats")))
    rows = rows.union(part(w.transactions, "t", "fee_sats", F.col("is_coinbase"), F.lit(None))).repartition("txid")
    marks = rows.groupBy("txid", "kind", "mark").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("coinbase").alias("coinbase"),
        F.count_if(~F.col("coinbase")).alias("ordinary"),
        F.sum(F.when((F.col("kind") == "o") | ~F.col("coinbase"), F.col("sats"))).alias("sats"),
        F.count_if((F.col("kind") == "i") & ~F.col("coinbase") & F.col("sats").isNull()).alias("unknown"),
    )
    of = lambda kind, column: F.sum(F.when(F.col("kind") == kind, F.col(column)))
    none = lambda c: F.coalesce(c, F.lit(0))
    here = W.partitionBy("txid")
    derived = F.when((of("i", "ordinary").over(here) > 0) & (of("i", "unknown").over(here) == 0), of("i", "sats").over(here) - of("o", "sats").over(here))
    fees = marks.withColumn("wrong", F.when(F.col("txid").isNotNull() & (F.col("kind") == "t") & (derived != F.col("mark")), F.col("ordinary")))
    per = fees.groupBy("txid").agg(
        *[none(of(k, "n")).alias(k) for k in "iot"],
        none(of("t", "ordinary")).alias("ordinary"),
        none(of("i", "coinbase")).alias("coinbase_inputs"),
        F.count_if((F.col("kind") == "i") & (F.col("n") > 1)).alias("c16"),
        F.count_if((F.col("kind") == "o") & (F.col("n") > 1)).alias("c22"),
        F.sum("wrong").alias("c26"),
    )
    known = F.col("txid").isNotNull()
    lacks = lambda kind: ((F.col("t") > 0) & ~(known & (F.col(kind) > 0))).cast("int")
    sums = per.agg(
        F.count_if(F.col("t") > 1).alias("c9"),
        F.sum(lacks("i") + lacks("o")).alias("c13"),
        F.count_if(known & (F.col("ordinary") > 0) & (F.col("coinbase_inputs") > 0)).alias("c15"),
        F.sum(F.when(~(known & (F.col("t") > 0)), F.col("o"))).alias("c25"),
        *[F.sum(c).alias(c) for c in ("c16", "c22", "c26")],
    )
    return _pairs(sums, [9, 13, 15, 16, 22, 25, 26])


def _by_block(w: Window) -> DataFrame:
    """Checks of transactions against their block, on their counts by height and hash, which map sides combine."""
    t = w.transactions.groupBy("block_height", "block_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_coinbase").alias("coinbase"))
    heights = w.all_blocks.groupBy("block_height").agg(F.count("block_hash").alias("hashes"), F.lit(True).alias("known"))
    same = w.all_blocks.groupBy("block_height", "block_hash").agg(F.count("block_hash").alias("equal"))
    joined = t.join(heights, "block_height", "left").join(same, ["block_height", "block_hash"], "left")
    other = F.col("hashes") - F.coalesce("equal", F.lit(0))
    per = joined.groupBy("block_height").agg(
        F.sum("coinbase").alias("coinbase"),
        F.sum(F.when(F.col("block_hash").isNotNull(), F.col("n") * other)).alias("c6"),
        F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("c10"),
    )
    return _pairs(per.agg(F.count_if(F.col("coinbase") != 1).alias("c5"), F.sum("c6").alias("c6"), F.sum("c10").alias("c10")), [5, 6, 10])


TOGETHER = {5, 6, 9, 10, 13, 15, 16, 22, 25, 26}


def counts(w: Window) -> DataFrame:
    """check_number and violations (all of them) of every check that can fail or warn."""
    parts = [_by_txid(w), _by_block(w)]
    for dataset in ("transactions", "inputs", "outputs"):
        local = [c for c in CHECKS if c.dataset == dataset]
        sums = getattr(w, dataset).agg(*[F.count_if(F.expr(c.predicate)).alias(f"c{c.number}") for c in local])
        parts.append(_pairs(sums, [c.number for c in local]))
    for c in CHECKS:
        if c.dataset is None and c.severity != BOUNDARY and c.number not in TOGETHER:
            parts.append(c.rows(w).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.number).alias("check_number"), "violations"))
    return reduce(DataFrame.union, parts)


def severities(w: Window) -> DataFrame:
    """check_number, check_id, category, severity, violations: a row for each of the 33 checks."""
    spark = w.blocks.sparkSession
    known = spark.createDataFrame([(c.number, c.id, c.category, c.severity) for c in CHECKS], "check_number int, check_id string, category string, on_violation string")
    joined = known.join(F.broadcast(counts(w)), "check_number", "left")
    severity = F.when(F.col("on_violation") == BOUNDARY, BOUNDARY).when(F.col("violations") > 0, F.col("on_violation")).otherwise(PASS)
    return joined.select("check_number", "check_id", "category", severity.alias("severity"), F.coalesce("violations", F.lit(0)).alias("violations"))


def _fetch(df: DataFrame, order: tuple[str, ...] = ()) -> list[dict]:
    if order:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return [r.asDict() for r in df.limit(SAMPLES).collect()]


def _details(c: Check, w: Window, exact: int) -> dict:
    if c.number == 8:
        return {"first_block": next(iter(_fetch(c.rows(w))), None)}
    if c.number in (20, 24, 33):
        d = c.rows(w).first().asDict()
        samples = {20: foreign_samples, 24: address_samples}.get(c.number)
        return d | ({"samples": _fetch(samples(w), ("txid",))} if samples else {})
    if c.number == 13:
        rows = {m: [r["txid"] for r in _fetch(c.rows(w).where(F.col("missing") == m), ("txid",))] if exact else [] for m in ("input", "output")}
        return {"txids_missing_inputs": rows["input"], "txids_missing_outputs": rows["output"]}
    d = {"violation_count": min(exact, SAMPLES) if c.capped else exact, "violation_count_exact": exact, "samples": _fetch(c.rows(w), c.order) if exact else []}
    return fee_summary(w).first().asDict() | d if c.number == 26 else d


def validate(w: Window) -> dict:
    """The report. Boundary checks never pass or fail; warnings leave the status at PASS."""
    found = {r["check_number"]: r for r in severities(w).collect()}
    checks = []
    for c in CHECKS:
        r = found[c.number]
        checks.append({"id": c.id, "category": c.category, "description": c.description, "severity": r["severity"], "passed": r["severity"] != FAIL, "details": _details(c, w, r["violations"])})
    observed = w.blocks.agg(F.min("block_height").alias("lo"), F.max("block_height").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    by = {c["id"]: c["details"] for c in checks}
    totals = {s: sum(c["severity"] == s for c in checks) for s in (PASS, BOUNDARY, WARN, FAIL)}
    foreign, unspent, nowhere = by["foreign_input_references"], by["outputs_unspent_within_window"], by["outputs_without_standard_address"]
    return {
        "requested_start_height": w.start,
        "requested_end_height": w.end,
        "observed_min_height": observed["lo"],
        "observed_max_height": observed["hi"],
        "expected_block_count": w.end - w.start + 1,
        "observed_block_count": observed["n"],
        "validated_at": datetime.now(timezone.utc).isoformat(),
        "checks": checks,
        "boundary_metrics": {
            "ordinary_inputs_referencing_before_window": {"count": foreign["foreign_count"], "pct": foreign["foreign_pct"]},
            "outputs_unspent_within_window": {"count": unspent["unspent_in_window_count"], "pct": unspent["unspent_in_window_pct"]},
            "outputs_without_standard_address": {"count": nowhere["no_address_count"], "pct": nowhere["no_address_pct"]},
            "first_block_lacks_loaded_predecessor": by["first_block_predecessor_unverifiable"]["first_block"],
        },
        "summary_statistics": {"size_weight_vsize": size_summary(w).first().asDict()},
        "severity_totals": totals,
        "overall_status": FAIL if totals[FAIL] else PASS,
    }


def report_path(folder: str, start: int, end: int) -> str:
    return os.path.join(folder, f"validation_{start}_{end}.json")


def write_report(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(report, f, indent=2, default=str)


def load_report(folder: str, start: int, end: int) -> dict:
    """The report of exactly this range, which must have passed."""
    path = report_path(folder, start, end)
    if not os.path.exists(path):
        raise RuntimeError(f"no validation report for {start}-{end} in {folder}")
    with open(path) as f:
        report = json.load(f)
    if (report.get("requested_start_height"), report.get("requested_end_height")) != (start, end):
        raise RuntimeError(f"{path} is for another range")
    if report.get("overall_status") != PASS:
        raise RuntimeError(f"the gate did not pass for {start}-{end}")
    return report


def print_report(report: dict) -> None:
    print(f"Validation {report['requested_start_height']}-{report['requested_end_height']}: {report['overall_status']}")
    for c in report["checks"]:
        print(f"  {c['severity']:<17} {c['id']}")
    print("  " + ", ".join(f"{k} {v}" for k, v in report["severity_totals"].items()))
