"""Quality by attention-based multiple-instance learning: a document is a bag of passages with one label.

Every passage (a line; longer lines are cut every PASSAGE_BYTES at a character) is described by shares of kinds of characters and
words, encoded by a tanh layer, weighted by gated attention, and the weighted mean is scored by a logistic unit:
a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))), score = sigmoid(c . sum(a_k h_k) + d).

Fitted on the driver on at most MOST_FITTED labelled rows of MOST_BYTES; the model is of fixed size. Null and empty texts are one empty
passage. Without labels of both kinds every score is the share of label 1 (0.5 without any). Equal texts have equal scores, whatever
row they are in; of passages of equal weight the first is told. All passages of a text count, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import free, schema_of, table, text_slices
from .labelled import MOST_FITTED, Adam, remainder, sample, sigmoid
from .words import LOWER, hashes, words

MODULUS, HELD_OUT, GOOD = 4, 2, 0.7
PASSAGE_BYTES = 2048
HIDDEN, GATES, EPOCHS, BATCH = 16, 8, 25, 64

#: Kinds of bytes whose shares describe a passage.
KINDS = [np.isin(np.arange(256), x) for x in (
    np.arange(97, 123), np.arange(65, 91), np.arange(48, 58), np.array([9, 32]), np.arange(128, 256), np.array([124]), np.array([33]), np.array([35, 36, 37, 38, 42]),
    np.array([44, 46]), np.array([34, 39, 40, 41, 45, 47, 58, 59, 63, 64, 91, 92, 93, 95, 60, 61, 62, 123, 125, 126, 94, 96, 43]),
)]
FEATURES = len(KINDS) + 8


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages (with the end of the last), and offsets of each text's passages."""
    n = len(buf)
    starts = np.concatenate((off[:-1], np.flatnonzero(buf == 10) + 1))
    starts = np.unique(starts[starts <= n])
    length = np.diff(np.concatenate((starts, [n])))
    long = np.flatnonzero(length > PASSAGE_BYTES)
    if len(long):
        count = (length[long] - 1) // PASSAGE_BYTES
        more = np.repeat(starts[long], count) + PASSAGE_BYTES * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        for _ in range(3):  # back to the first byte of a character
            more = more - ((more < n) & ((buf[np.minimum(more, n - 1)] & 0xC0) == 0x80))
        starts = np.unique(np.concatenate((starts, more)))
    # Empty texts share their start with the next one; each gets a passage of its own.
    empty = off[:-1][off[1:] == off[:-1]]
    full_starts = starts[starts < n]
    all_starts = np.sort(np.concatenate((full_starts, empty)), kind="stable")
    return np.concatenate((all_starts, [n])), np.searchsorted(all_starts, off) if not len(empty) else _text_offsets(all_starts, off)


def _text_offsets(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    at = np.searchsorted(starts, off)
    # Among equal starts the empty texts come first, in order.
    for i in np.flatnonzero(off[1:] == off[:-1]).tolist():
        at[i + 1] = at[i] + 1
    at[-1] = len(starts)
    return at


def describe(buf: np.ndarray, starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each passage."""
    n = len(starts) - 1
    size = np.diff(starts)
    x = np.zeros((n, FEATURES))
    bytes_ = np.maximum(size, 1)
    for k, kind in enumerate(KINDS):
        total = np.concatenate(([0], np.cumsum(kind[buf], dtype=np.int64)))
        x[:, k] = (total[starts[1:]] - total[starts[:-1]]) / bytes_
    ws, we, _ = words(buf, off)
    of = np.searchsorted(starts[:-1], ws, "right") - 1
    count = np.bincount(of, minlength=n)[:n] if n else np.zeros(0)
    per = np.maximum(count, 1)
    h = hashes(LOWER[buf], ws, we)
    same = np.zeros(len(ws))
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    if len(ws):
        last, head = buf[we - 1], buf[ws]
        letter = (LOWER[head] >= 97) & (LOWER[head] < 123) | (head >= 128)
        odd_end = np.isin(last, (33, 35, 36, 37, 38, 42, 124))
        upper = (head >= 65) & (head < 91)
        for j, v in enumerate((same, ~letter, odd_end, upper)):
            x[:, len(KINDS) + j] = np.bincount(of, v, n)[:n] / per
    x[:, len(KINDS) + 4] = np.log1p(size) / 8
    x[:, len(KINDS) + 5] = np.log1p(count) / 6
    x[:, len(KINDS) + 6] = np.minimum(size / per, 40) / 10
    x[:, len(KINDS) + 7] = size == 0
    return x


class Bags:
    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, share: float | None = None):
        self.p, self.mean, self.scale, self.share = p, mean, scale, share

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """All steps' values; bags are x[at[i]:at[i + 1]], none empty."""
        p, begin, size = self.p, at[:-1], np.diff(at)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), size))
        a = e / np.repeat(np.add.reduceat(e, begin), size)
        z = np.add.reduceat(a[:, None] * h, begin)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "s": sigmoid(z @ p["c"] + p["d"])}

    def backward(self, f: dict[str, np.ndarray], at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, begin, size = self.p, at[:-1], np.diff(at)
        g = (f["s"] - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], size, 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begin), size))
        dv, du = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        grads = {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}
        return {k: v + 1e-4 * p[k] for k, v in grads.items()}

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, and the place in bytes of its passage of greatest weight."""
        starts, at = passages(buf, off)
        if self.share is not None:
            return np.full(len(off) - 1, self.share), np.zeros(len(off) - 1, np.int64)
        f = self.forward(describe(buf, starts, off), at)
        top = np.maximum.reduceat(f["a"], at[:-1])
        first = np.flatnonzero(f["a"] == np.repeat(top, np.diff(at)))
        doc = np.searchsorted(at, first, "right") - 1
        keep = np.unique(doc, return_index=True)[1]
        return f["s"], starts[first[keep]] - off[:-1]


def fit(texts: list[str], label: np.ndarray, shift: float = 0.0) -> Bags:
    """shift: added to the log odds, where label 1 is rarer or more common among all documents than here."""
    n1 = int((label == 1).sum())
    if not n1 or n1 == len(label):
        return Bags({}, np.zeros(FEATURES), np.ones(FEATURES), n1 / len(label) if len(label) else 0.5)
    found, sizes = [], []
    for _, _, buf, off in text_slices(pa.array(texts, pa.large_string())):
        starts, at = passages(buf, off)
        found.append(describe(buf, starts, off))
        sizes.append(np.diff(at))
    x, at = np.concatenate(found), np.cumsum(np.concatenate([[0], *sizes]))
    rng = np.random.default_rng(17)
    draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.array([np.log(n1 / (len(label) - n1))])}
    model = Bags(p, x.mean(0), x.std(0) + 0.02)
    adam = Adam(p, 0.01)
    size = np.diff(at)
    rounds = max(EPOCHS, -(-600 * BATCH // len(label)))
    for r in range(rounds):
        if r == rounds * 2 // 3:
            adam.rate /= 5
        order = rng.permutation(len(label))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            s = size[docs]
            ends = np.cumsum(s)
            rows = np.repeat(at[:-1][docs] - (ends - s), s) + np.arange(ends[-1])
            bounds = np.concatenate(([0], ends))
            f = model.forward(x[rows], bounds)
            adam.step(model.backward(f, bounds, label[docs]))
    p["d"] += shift
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FITTED) -> Bags:
    return fit(*sample(docs, labels, "quality", MODULUS, HELD_OUT, most))


def score(docs: DataFrame, model: Bags, column: str = "text") -> DataFrame:
    """Adds quality_score and quality_passage (the byte at which the passage of greatest weight begins), with __ before their names where
    there are such columns already."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few KB, whatever the input
    names = docs.columns
    new = free(["quality_score", "quality_passage"], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(column)):
                s, place = held.value.score(buf, off)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(s), pa.array(place, pa.int64())], names=[*names, *new])

    return docs.mapInArrow(run, schema_of(docs, f"`{new[0]}` double", f"`{new[1]}` bigint"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"), "quality_passage")
