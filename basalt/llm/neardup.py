"""Near duplicates of documents by circulant MinHash.

Two permutations make all coordinates of a signature: one scatters the shingles, the other is shifted circularly by one
more place for each coordinate. Bands of the signature give candidates; links are confirmed on full shingle sets, first of
shingles' hashes, then of their words. Equal sets are one node from the start, so groups of exact copies never meet in a bucket; they are
known by 128 bits of a digest of their shingles' hashes.

A pair at the threshold of 0.8 shares none of BANDS bands of ROWS coordinates with a chance of (1 - 0.8^4)^24 = 3e-6.

Defined results: null and empty texts, and those of blanks alone, have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle; rows that repeat a doc_id are one document, with the links of all its
texts; rows without doc_id link with nothing and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, sub_batches, table, text_slices
from .components import components
from .linking import link, pick
from .shingles import band_keys, signatures, word_shingles

BANDS, ROWS, PERCENT = 24, 4, 80


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, hash of the set in two numbers, and band keys, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column("text")):
                values, at = word_shingles(buf, off, words)
                raw = values.tobytes()
                h = np.frombuffer(b"".join(hashlib.md5(raw[8 * i : 8 * j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())), np.int64).reshape(-1, 2)
                keys = band_keys(signatures(values, at, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), lists], names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>")


def lowered(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, joined by a space."""
    return b" ".join((text or "").encode().lower().split())


def sets_of(docs: DataFrame):
    """Of ids: id and set, the words of its text, of which shingles are made where they are compared. An id may have several."""

    def make(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sub_batches(batch, "text"):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([lowered(t) for t in part.column("text").to_pylist()], pa.binary())], names=["id", "set"])

        return pick(docs.select("doc_id", "text"), ids, "doc_id").mapInArrow(run, "id bigint, set binary")

    return make


def opener(words: int):
    def opened(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, buf, off in text_slices(column):
            values, at = word_shingles(buf, off, words)
            out += [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        return out

    return opened


def by_words(words: int, percent: int):
    """Whether two texts of `lowered` are similar by their shingles' words."""

    def shingles(x: bytes) -> set[tuple[bytes, ...]]:
        w = x.split()
        return set(zip(*(w[k:] for k in range(words)))) if len(w) >= words else {tuple(w)} if w else set()

    def exact(x: bytes, y: bytes) -> bool:
        a, b = shingles(x), shingles(y)
        both = len(a & b)
        return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)

    return exact


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id = component_id), a row for each row."""
    scratch = Scratch(docs.sparkSession, "near")
    all_ = scratch.keep(signed(docs, words, bands, rows), "signed")
    real = all_.where("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal keys.
    nodes = scratch.keep(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "nodes")
    classes = nodes.select("h1", "h2", "rep")
    roots = link(nodes.select(F.col("rep").alias("id"), "keys"), sets_of(docs), percent, scratch, opener(words), 6, by_words(words, percent))
    # Texts of one doc_id are one document: their classes are linked, and texts without shingles go with them.
    of = real.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "rep")
    least = of.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    same = scratch.keep(of.join(least, "doc_id").where("rep <> lo").select(F.col("rep").alias("u"), F.col("lo").alias("v")).distinct(), "same")
    if same.limit(1).count():
        roots = components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).union(same), scratch)
    bare = all_.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    bare = scratch.keep(of.join(bare, "doc_id").groupBy("doc_id").agg(F.min("rep").alias("other")), "bare")
    out = all_.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    out = out.withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")))
    if bare.limit(1).count():
        out = out.join(bare, "doc_id", "left").withColumn("rep", F.coalesce("rep", "other"))
    out = out.join(roots, F.col("rep") == F.col("id"), "left").withColumn("component_id", F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(i, j) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.i, l.j FROM reach r JOIN (SELECT i, j FROM links UNION ALL SELECT j, i FROM links) l ON l.i = r.j)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM s JOIN (SELECT i, min(j) AS c FROM reach GROUP BY i) c ON c.i = s.doc_id
"""
