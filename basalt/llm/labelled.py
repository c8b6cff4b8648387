"""Labelled rows to fit on: a bounded sample, chosen by a hash of doc_id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch

#: The most labelled rows that a classifier is fitted on.
MOST_FITTED = 2500
#: The most bytes that their texts have; longer rows are passed over.
MOST_BYTES = 32 << 20


def remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int = MOST_FITTED, most_bytes: int = MOST_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of labelled documents whose remainder is not the held-out one, and what the log odds of label 1 are to be shifted by.

    Half of `most` of each label at most, of those that have a document, by a hash of doc_id; of these as many as have `most_bytes` in all.
    As labels are drawn apart, their share among all labelled documents is given as the shift. Rows with a null label or doc_id are left
    out; of a doc_id's labels and texts the smallest count."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    scratch = Scratch(docs.sparkSession, "labelled")
    rows = scratch.keep(rows, "rows")
    share = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = [r for k in (0, 1) for r in rows.where(F.col("label") == k).orderBy(*order).limit(max(1, most // 2)).collect()]
    picked = docs.sparkSession.createDataFrame(picked, "doc_id bigint, label int")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = scratch.keep(found, "texts")
    sizes = found.select("doc_id", F.octet_length("text").alias("size"), order[0].alias("place")).orderBy("place", "doc_id").collect()
    room, chosen = most_bytes, []
    for r in sizes:
        if r["size"] <= room:
            chosen.append((r["doc_id"],))
            room -= r["size"]
    some = found.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint")), "doc_id").orderBy("doc_id").collect()
    y = np.array([r["label"] for r in some], np.int64)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    shift = float(np.log(share[1] / share[0]) - np.log(n1 / n0)) if n1 and n0 else 0.0
    scratch.drop(rows, found)
    return [r["text"] for r in some], y, shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
