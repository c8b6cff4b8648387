"""From raw documents to tokens: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and reread as the next one's docs. All but
the last return the columns of docs, whatever other columns and names these have.

Texts may be null or empty in any stage; such documents are clean, are near duplicates of nothing, and have no tokens. A document whose
every line goes in line dedup goes with them: it is a copy, not an empty document. Rows that repeat a doc_id and its text are one
document in line dedup, which gives both rows the same text, and in near dedup; both are mixed and encoded. Rows without doc_id are kept by
near dedup. Equal lines, and near duplicates, are ordered by doc_id: the least stays. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import bpe, lines, mixing, neardup, toxicity
from basalt.llm.base import Scratch, table
from basalt.llm.linking import pick

TOXIC_FROM = 0.5
SHINGLE_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores below TOXIC_FROM; it is fitted on labelled ones among docs."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("*", F.col("text").alias("__text")), field, "__text")
    return scored.where(F.col(scored.columns[-2]) < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; n_chars is counted anew. Documents that had lines and
    have none left, or blank ones alone, are copies through and through and go."""
    out = lines.line_dedup(docs)
    emptied = (F.col(out.columns[-1]) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id."""
    found = neardup.near_duplicates(docs, words=SHINGLE_WORDS)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    if gone.limit(1).count() == 0:
        return docs
    return pick(docs, gone, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text, with their number and the digests of the ids and of what they decode to."""
    path = bpe.tokenizer_file("word_bpe_49k.json")
    return bpe.encode(docs.select("doc_id", "source", "text"), path, both=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The toxicity field, union-find over fuzzy lines and byte pairs have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return docs
