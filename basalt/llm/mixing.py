"""Mixing sources to target weights by Poisson replication.

A source's rate is (its target share of the output's characters) * (characters in all) / (its characters). Each document is
repeated Poisson(rate) times; the number comes from inverting the distribution at a uniform number hashed from
doc_id and seed, so it is the same wherever and however often it is computed. Rates above CHUNK are sums of
draws at equal smaller rates. All copies are ordered by a hash of doc_id, copy and seed: a global shuffle. As such hashes are spread
evenly, a copy's partition is the hash's share of all hashes; nothing is sampled first, and the draws are made once.

Defined results: a null source is a source of its own (with weights, that of the key None); sources without a weight, and sources of
empty texts alone, have rate 0; rows of equal doc_id in one source are repeated alike, and of equal keys the order is by doc_id,
copy and source; null doc_ids hash as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, input_bytes, table

SEED = 20240229
CHUNK, TERMS = 16, 96
#: Up to so many sources, their table is broadcast; beyond, it is joined.
MOST_SOURCES = 10_000
#: Bytes of input to a partition of the mix.
PARTITION_BYTES = 128 << 20
#: Target weights are characters to this power where none are given.
TEMPER = 0.5


def _uniform(key: Column, seed: int, draw: Column) -> Column:
    """48 bits of a hash as a number in [0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("-", key, F.lit(str(seed)), draw.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = TEMPER, size: float = 1.0) -> DataFrame:
    """source, chars, rate. weights: shares of the output by source, in any scale; else chars to the power temper."""
    chars = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    stats = Scratch(docs.sparkSession, "sources").keep(docs.groupBy("source").agg(F.sum(chars).alias("chars")))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(temper)) if temper != 0.5 else F.sqrt(F.col("chars").cast("double"))
    else:
        named = [F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]
        weight = F.coalesce(F.create_map(*named)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if named else F.lit(0.0)
        weight = F.when(F.col("source").isNull(), float(weights.get(None, 0.0))).otherwise(weight)
    stats = stats.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = stats.agg(F.sum("weight").alias("w"), F.sum("chars").alias("c")).first()
    if not total["w"]:
        return stats.select("source", "chars", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(total["w"]))
    return stats.select("source", "chars", F.coalesce(F.try_divide(share * F.lit(float(total["c"]) * size), F.col("chars").cast("double")), F.lit(0.0)).alias("rate"))


def with_cdf(by_source: DataFrame) -> DataFrame:
    """Adds draws (how many) and cdf (of one draw, TERMS values) to the rates."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int")
    mean = F.col("rate") / F.col("draws")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def term(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, term, lambda acc: acc["cdf"])
    return by_source.withColumn("draws", draws).withColumn("cdf", cdf)


def replicate(docs: DataFrame, by_source: DataFrame, seed: int = SEED) -> DataFrame:
    """Every document as often as its draw says, with __rate, __copy (from 1) and __key, its place, not yet in order."""
    spark = docs.sparkSession
    rows = by_source.limit(MOST_SOURCES + 1).collect()
    small = len(rows) <= MOST_SOURCES
    s = with_cdf(spark.createDataFrame(rows, by_source.schema) if small else by_source)
    s = s.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf"))
    s = F.broadcast(s) if small else s
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    cols = docs.columns
    joined = docs.join(s, docs["source"].eqNullSafe(F.col("__source")))
    # The uniform numbers first: a lambda's body is evaluated for each element it is called with.
    uniform = F.transform(F.sequence(F.lit(1), F.col("__draws")), lambda j: _uniform(key, seed, j))
    n = F.aggregate(uniform, F.lit(0), lambda acc, u: acc + F.size(F.filter("__cdf", lambda c: c <= u)))
    out = joined.select(*cols, "__rate", F.explode(F.sequence(F.lit(0), n)).alias("__copy")).where("__copy > 0")
    return out.withColumn("__key", F.md5(F.concat_ws("-", key, F.col("__copy").cast("string"), F.lit(str(seed)), F.lit("order"))))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, temper: float = TEMPER, size: float = 1.0) -> DataFrame:
    """The documents mixed to the weights, in their new order; all columns of docs, and rate, copy and shuffle_key, which have __ before
    their names where docs has such a column already."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // PARTITION_BYTES)
    out = replicate(docs, rates(docs, weights, temper, size), seed)
    share = F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * n
    out = out.repartitionById(n, F.shiftright(share, 32).cast("int")).sortWithinPartitions("__key", "doc_id", "__copy", "source")
    new = {"__rate": "rate", "__copy": "copy", "__key": "shuffle_key"}
    return out.select(*docs.columns, *[F.col(c).alias(n if n not in docs.columns else f"__{n}") for c, n in new.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with their texts, in the global order; what is told of a text is computed behind the shuffle."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "source", "rate", F.col("copy").cast("bigint").alias("copy"), "shuffle_key", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def mixing_sql(docs: str, seed: int = SEED) -> str:
    """The same in SQL over a relation with doc_id, source and text: common table expressions ending in `mixed`."""
    return f"""
s5 AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM {docs} GROUP BY source),
w5 AS (SELECT source, chars, CASE WHEN chars > 0 THEN sqrt(CAST(chars AS DOUBLE)) ELSE 0 END AS weight FROM s5),
t5 AS (SELECT sum(weight) AS w, CAST(sum(chars) AS DOUBLE) AS c FROM w5),
r5 AS (SELECT source, CASE WHEN chars > 0 THEN weight / w * c / CAST(chars AS DOUBLE) ELSE 0 END AS rate FROM w5, t5),
d5 AS (SELECT *, greatest(1, CAST(ceil(rate / {CHUNK}) AS INT)) AS draws FROM r5),
k5 AS (SELECT source, k, rate, draws, sum(CASE WHEN rate = 0 THEN CASE WHEN k = 0 THEN 1 ELSE 0 END ELSE exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM d5, range(0, {TERMS}) t(k)),
u5 AS (SELECT d.row, doc_id, d.source, d.text, d5.rate, j, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-{seed}-' || j), 1, 12) AS BIGINT) / {float(1 << 48)!r} AS u
  FROM (SELECT *, row_number() OVER () AS row FROM {docs}) d JOIN d5 ON d.source IS NOT DISTINCT FROM d5.source, LATERAL (SELECT unnest(range(1, draws + 1)) AS j)),
n5 AS (SELECT u5.row, u5.doc_id, u5.source, u5.text, u5.rate, count(*) FILTER (WHERE k5.cdf <= u5.u) AS n FROM u5 JOIN k5 ON u5.source IS NOT DISTINCT FROM k5.source GROUP BY ALL),
mixed AS (SELECT doc_id, source, text, rate, unnest(range(1, n + 1)) AS copy FROM n5)"""


ORACLE = f"""WITH {mixing_sql("documents")}
SELECT doc_id, source, rate, copy, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-' || copy || '-{SEED}-order') AS shuffle_key,
  CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM mixed"""
