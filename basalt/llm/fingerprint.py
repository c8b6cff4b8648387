"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph (a line of the text) is hashed by SHA-256 and widened, by SHA-256 of that and a number, to LANES signed 16-bit numbers. A
document's fingerprint is the lane-wise sum over its paragraphs modulo 2^32. So the order of paragraphs
does not matter, and inserting or deleting a paragraph adds or subtracts its vector (`combine`, `remove`).
Lanes of unrelated paragraphs are independent with mean near 0, so the dot product of two fingerprints
estimates the number of paragraphs they share (`likeness`).

Defined results: null and empty texts have no paragraph and the zero vector; blank lines are paragraphs;
repeated paragraphs count as often as they occur; texts of any length are hashed whole. Rows of one doc_id follow each other in the
order of a hash of their texts, null ids come first, and the last row's next is the first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import input_bytes, table

LANES = 64
MOD = 1 << 32
#: Bytes of input to a range of neighbouring ids; the ranges' first keys go to the driver and back, some 30 bytes each.
RANGE_BYTES = 64 << 20


def _zero() -> Column:
    return F.array(*[F.lit(0).cast("bigint")] * LANES)


def _lanes(digits: Column) -> Column:
    """LANES numbers from -32768 to 32767 out of four hexadecimal digits each, two at a time."""
    two = lambda i: F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint")
    half = lambda x, j: F.shiftright(F.shiftleft(x, 48 - 16 * j), 48)
    pairs = F.array(*[two(i) for i in range(LANES // 2)])
    return F.flatten(F.transform(pairs, lambda x: F.array(half(x, 1), half(x, 0))))


def fingerprint(text: Column) -> Column:
    """array<bigint>: the fingerprint of a text column, lanes in [0, 2^32)."""
    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 256))  # bound first: a lambda's body is copied where it is used
    wide = F.transform(digests, lambda d: F.concat(*[F.sha2(F.concat(d, F.lit(f"-{g}")), 256) for g in range(LANES // 16)]))
    vectors = F.transform(wide, _lanes)
    return F.aggregate(vectors, _zero(), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b), lambda acc: F.transform(acc, lambda a: F.pmod(a, F.lit(MOD))))


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets: insertion."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MOD)))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of a without b: deletion."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MOD)))


def as_text(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of paragraphs that two fingerprints have in common; equal ones have 1."""
    signed = lambda v: F.transform(v, lambda x: F.when(x >= MOD // 2, x - MOD).otherwise(x).cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    sa, sb = signed(a), signed(b)
    dot = total(F.zip_with(sa, sb, lambda x, y: x * y))
    norm = total(F.zip_with(sa, sb, lambda x, y: x * x + y * y)) - dot
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot, norm), F.lit(0.0)))))


def _bucket(bounds: Column, n: int, key: Column) -> Column:
    """The last of n sorted bounds that is not above the key, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        right = (at["lo"] < at["hi"]) & (F.get(bounds, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(mid).alias("hi"))

    return F.greatest(F.lit(0), F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda at: at["lo"]) - 1)


def with_next(docs: DataFrame, add: dict[str, Column], carry: list[str]) -> DataFrame:
    """docs with the columns of add, and next_<c> for each column c of carry: its value in the row with the next doc_id, after the last
    the first.

    Spark's range partitioning finds the first keys of ranges of as many bytes, whatever the ids are; rows are dealt by these, and the
    first row of each range is sent to the range before too, so texts are shuffled once and no task sees more than a range. The columns
    of add are made behind that shuffle. The first keys, one a range, are all that the driver sees.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("__key", F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("tie")))
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // RANGE_BYTES)
    ranged = docs.select("__key").repartitionByRange(n, "__key").withColumn("part", F.spark_partition_id())
    firsts = sorted(tuple(r["k"]) for r in ranged.groupBy("part").agg(F.min("__key").alias("k")).collect())
    bounds = F.from_json(F.lit(json.dumps([{"known": k, "id": i, "tie": t} for k, i, t in firsts])), "array<struct<known boolean, id bigint, tie bigint>>")  # folded into the plan
    last = max(0, len(firsts) - 1)
    rows = docs.withColumn("__bucket", _bucket(bounds, len(firsts), F.col("__key")))
    before = F.when(F.get(bounds, F.col("__bucket")) == F.col("__key"), F.when(F.col("__bucket") == 0, last).otherwise(F.col("__bucket") - 1))
    # A ghost stands after all rows of the range it is sent to.
    own, ghost = F.struct(F.col("__bucket").alias("to"), F.lit(0).alias("ghost")), F.struct(before.alias("to"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("__at", F.explode(F.when(before.isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    rows = rows.select(*docs.columns, F.col("__at.to").alias("__to"), F.col("__at.ghost").alias("__ghost")).repartition("__to").withColumns(add)
    w = W.partitionBy("__to").orderBy("__ghost", "__key")
    for c in carry:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    return rows.where("__ghost = 0").drop("__ghost", "__to", "__key")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"fp": fingerprint(F.col("text"))}, ["text", "fp"]).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


#: For tables whose doc_id is unique and not null.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nt,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM documents),
texts AS (SELECT doc_id, 0 AS edited, t FROM d UNION ALL SELECT doc_id, 1, left(t, n - n // 2) || left(nt, n // 2) FROM d),
paragraphs AS (SELECT doc_id, edited, sha256(unnest(string_split(t, chr(10)))) AS h FROM texts WHERE t <> ''),
wide AS (SELECT doc_id, edited, concat({", ".join(f"sha256(h || '-{g}')" for g in range(LANES // 16))}) AS w FROM paragraphs),
lanes AS (SELECT doc_id, edited, k, CAST('0x' || substr(w, CAST(4 * k + 1 AS INT), 4) AS BIGINT) AS v FROM wide, range({LANES}) r(k)),
sums AS (SELECT t.doc_id, t.edited, r.k, coalesce(sum(CASE WHEN v >= 32768 THEN v - 65536 ELSE v END), 0) AS s FROM texts t CROSS JOIN range({LANES}) r(k) LEFT JOIN lanes l ON l.doc_id = t.doc_id AND l.edited = t.edited AND l.k = r.k GROUP BY ALL),
fp AS (SELECT doc_id, edited, list(CAST(((s % {MOD}) + {MOD}) % {MOD} AS BIGINT) ORDER BY k) AS f FROM sums GROUP BY ALL),
two AS (SELECT d.doc_id, d.n, a.f AS fa, b.f AS fb, c.f AS fc, e.t AS edited FROM d JOIN fp a ON a.doc_id = d.doc_id AND a.edited = 0 JOIN fp b ON b.doc_id = d.doc_id AND b.edited = 1
  JOIN fp c ON c.doc_id = d.next_id AND c.edited = 0 JOIN texts e ON e.doc_id = d.doc_id AND e.edited = 1),
real AS (SELECT *, {", ".join(f"list_transform(f{x}, lambda v: CAST(CASE WHEN v >= {MOD // 2} THEN v - {MOD} ELSE v END AS DOUBLE)) AS r{x}" for x in "abc")} FROM two),
dots AS (SELECT *, {", ".join(f"list_sum(list_transform(list_zip(r{x}, r{y}), lambda z: z[1] * z[2])) AS d{x}{y}" for x, y in ("ab", "ac", "aa", "bb", "cc"))} FROM real)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(list_transform(fa, lambda v: printf('%08x', v)), '') AS fingerprint, array_to_string(list_transform(fb, lambda v: printf('%08x', v)), '') AS edited_fingerprint,
  {", ".join(f"CASE WHEN fa = f{y} THEN 1.0 WHEN daa + d{y}{y} - da{y} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, da{y} / (daa + d{y}{y} - da{y}))) END::DOUBLE AS {name}" for y, name in (("b", "near_edited"), ("c", "near_next")))} FROM dots
"""
