"""Toxicity by a linear-chain conditional random field over words.

Words are runs of letters and digits, ASCII lower-cased, by hash. The field has two states; each word has a weight for the
toxic state, and there are weights for the steps between states. Labelled tokens come from labelled documents: in a
toxic document, the words that toxic documents have significantly more often than others (log-likelihood ratio).
Forward and backward passes go over whole texts, many texts a step; the marginals give toxic spans (byte offsets)
and, by their greatest and their sum, the document's score, a logistic function fitted on the documents' labels.

Fitted on the driver, on at most MOST_FITTED labelled rows of MOST_BYTES; the model is of fixed size. Without labels of both kinds every
score is the toxic share (0.5 without any). Null and empty texts have the score of a text without toxic words; equal texts have equal
scores and spans, whatever row they are in; spans are bytes of the UTF-8 text. A text is one chain whatever its length: the passes over
a long one go in as many steps as the root of its words, all its parts together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import free, schema_of, table, text_slices
from .labelled import MOST_FITTED, Adam, remainder, sample, sigmoid
from .words import LETTER, LOWER, MIX1, MIX2, hashes, mix, spans

MODULUS, HELD_OUT = 5, 0
#: Words with a weight of their own: the significant ones, and so many of the most frequent; others share one.
FREQUENT, SLOT_BITS = 4096, 18
#: Words count as toxic from this log-likelihood ratio on (a chance of about one in 100,000).
SIGNIFICANT = 20.0
#: They are so many times as common in toxic documents as in others, at least.
TIMES = 4.0
#: Training chains end after so many words; only fitting cuts them.
CHAIN, ROUNDS = 64, 40
SLICE = 4 << 20
#: Chains of more words are passed over in parts.
LONG_CHAIN = 1 << 14
#: Pairs of words whose chances are computed at once in fitting.
PAIRS = 1 << 17


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends, offsets of each text's words."""
    start, end, at = spans(LETTER[buf], off)
    return hashes(LOWER[buf], start, end), start, end, at


def forward(u: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Log ratios of toxic to clean at each word, of all that is up to it. Chains advance together, longest first; those of more than
    LONG_CHAIN words each by itself."""
    size = np.diff(at)
    f = u.copy()
    for k in np.flatnonzero(size > LONG_CHAIN).tolist():
        f[at[k] : at[k + 1]] = _forward_long(u[at[k] : at[k + 1]], steps)
    size = np.where(size > LONG_CHAIN, 0, size)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), "left")  # chains longer than the step
    (a, b), (c, d) = np.exp(steps)
    # In weights rather than logs; ratios stay within what exp can hold as u is bounded.
    for t in range(1, most):
        i = begin[: live[t]] + t
        r = np.exp(np.clip(f[i - 1], -60, 60))
        f[i] += np.log((b + r * d) / (a + r * c))
    return f


def _forward_long(u: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """forward() for one chain: a step is a matrix of weights, so parts of the chain are multiplied up side by side, then joined, then
    passed through from the ratios they begin with."""
    (a, b), (c, d) = np.exp(steps)
    n = len(u) - 1
    width = math.isqrt(n) + 1
    parts = -(-n // width)
    e = np.ones(parts * width)
    e[:n] = np.exp(np.clip(u[1:], -60, 60))
    e = e.reshape(parts, width).T.copy()
    p00, p01, p10, p11 = np.ones(parts), np.zeros(parts), np.zeros(parts), np.ones(parts)
    for x in e:
        p00, p01, p10, p11 = a * p00 + c * p10, a * p01 + c * p11, x * (b * p00 + d * p10), x * (b * p01 + d * p11)
        total = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
    low, high = np.exp(-60.0), np.exp(60.0)
    start = np.empty(parts)
    r = math.exp(min(max(float(u[0]), -60.0), 60.0))
    for k in range(parts):
        start[k] = r
        r = min(max((p10[k] + p11[k] * r) / (p00[k] + p01[k] * r), low), high)
    out, r = np.empty_like(e), start
    for t, x in enumerate(e):
        out[t] = r = np.clip(x * (b + r * d) / (a + r * c), low, high)
    return np.concatenate((u[:1], np.log(out.T.ravel()[:n])))


def passes(u: np.ndarray, at: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log ratios of toxic to clean at each word, whose sum is the marginal's.

    u: log weight of toxic over clean; steps[i, j]: log weight from i to j. Backward is forward on the reverse, without the word's own
    weight."""
    back = forward(u[::-1], (at[-1] - at)[::-1], steps.T)[::-1] - u
    return forward(u, at, steps), back


def marginals(u: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    f, back = passes(u, at, steps)
    return sigmoid(f + back)


class Field:
    """keys: hashes of the words with weights of their own, found through slots; common: the others' weight."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, common: float, steps: np.ndarray, score: np.ndarray):
        self.keys, self.own, self.common, self.steps, self.score = keys, own, common, steps, score
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        for i in np.argsort(own, kind="stable").tolist():  # where two meet, the one of greater weight stays
            self.slots[int(keys[i]) >> (64 - SLOT_BITS)] = i

    def weigh(self, w: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(w), self.common)
        i = self.slots[w >> np.uint64(64 - SLOT_BITS)]
        return np.where((i >= 0) & (self.keys[i] == w), self.own[i], self.common)

    def document(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        return sigmoid(self.score[0] + self.score[1] * most + self.score[2] * np.log1p(total))

    def tag(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each text's score, and its toxic spans as start, end, start, end and so on."""
        w, start, end, at = tokens(buf, off)
        p = marginals(self.weigh(w), at, self.steps)
        most, total = per_text(p, at)
        found: list[list[int]] = [[] for _ in range(len(off) - 1)]
        hit = np.flatnonzero(p >= 0.5)
        doc = np.searchsorted(at, hit, "right") - 1
        last = (-1, -1)
        for i, d in zip(hit.tolist(), doc.tolist()):
            if last == (i - 1, d):
                found[d][-1] = int(end[i] - off[d])
            else:
                found[d] += [int(start[i] - off[d]), int(end[i] - off[d])]
            last = (i, d)
        return self.document(most, total), found


def per_text(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = at[1:] > at[:-1]
    most, total = np.zeros(len(full)), np.zeros(len(full))
    if full.any():
        most[full] = np.maximum.reduceat(p, at[:-1][full])
        total[full] = np.add.reduceat(p, at[:-1][full])
    return most, total


def toxic_words(index: np.ndarray, n: int, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Whether a word is significantly more common in documents of label 1; for word indexes 0 to n - 1.

    An occurrence counts once for its two neighbours, so copies of a document add nothing."""
    doc = np.repeat(np.arange(len(label)), np.diff(at))
    padded = np.concatenate(([n], index, [n])).astype(np.uint64)
    around = mix(padded[:-2] * MIX1 + padded[1:-1]) * MIX2 + padded[2:]
    bad = label[doc] == 1
    k1, k0 = (np.bincount(index[chosen][np.unique(around[chosen], return_index=True)[1]], minlength=n).astype(float) for chosen in (bad, ~bad))
    n1, n0 = max(1.0, k1.sum()), max(1.0, k0.sum())
    p = (k1 + k0) / (n1 + n0)

    def fit(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(p), nan=0.0) + np.nan_to_num((n - k) * np.log1p(-p), nan=0.0)

    ratio = 2 * (fit(k1, n1, k1 / n1) + fit(k0, n0, k0 / n0) - fit(k1, n1, p) - fit(k0, n0, p))
    return (k1 / n1 > TIMES * k0 / n0) & (ratio >= SIGNIFICANT)


def fit(texts: list[str], label: np.ndarray, shift: float = 0.0) -> Field:
    """shift: added to the log odds, where label 1 is rarer or more common among all documents than here."""
    n1 = int((label == 1).sum())
    none = np.zeros(0)
    if not n1 or n1 == len(label):
        share = n1 / len(label) if len(label) else 0.5
        return Field(none.astype(np.uint64), none, -6.0, np.zeros((2, 2)), np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0, 0]))
    found, sizes = [], []
    for _, _, buf, off in text_slices(pa.array(texts, pa.large_string())):
        h, _, _, at = tokens(buf, off)
        found.append(h)
        sizes.append(np.diff(at))
    w, at = np.concatenate(found), np.cumsum(np.concatenate([[0], *sizes]))
    doc = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(at))
    words, index, count = np.unique(w, return_inverse=True, return_counts=True)
    toxic = toxic_words(index, len(words), at, label)
    y = (toxic[index] & (label[doc] == 1)).astype(float)
    # Index 0 is for the words without a weight of their own.
    keyed = np.union1d(np.flatnonzero(toxic), np.argsort(-count, kind="stable")[:FREQUENT])
    of = np.zeros(len(words), np.int32)
    of[keyed] = np.arange(1, len(keyed) + 1)
    index = of[index]
    place = np.arange(len(w)) - at[:-1][doc]
    first = place % CHAIN == 0
    cuts = np.concatenate((np.flatnonzero(first), [len(w)]))
    pair = np.flatnonzero(~first)
    p = {"word": np.zeros(len(keyed) + 1), "common": np.array([-4.0]), "steps": np.zeros((2, 2))}
    adam = Adam(p, 0.4)
    real = np.zeros((2, 2))
    np.add.at(real, (y[pair - 1].astype(int), y[pair].astype(int)), 1)
    for _ in range(ROUNDS):
        u = (p["common"] + p["word"])[index]
        f, back = passes(u, cuts, p["steps"])
        gap = sigmoid(f + back) - y
        # The chance of each pair of states: forward to the first, the step, the second's weight and backward.
        both = np.zeros((2, 2))
        for k in range(0, len(pair), PAIRS):
            j = pair[k : k + PAIRS]
            before, after = f[j - 1], u[j] + back[j]
            e = p["steps"][:, :, None] + np.stack([np.stack([0 * before, after]), np.stack([before, before + after])])
            e = np.exp(e - e.max((0, 1)))
            both += (e / e.sum((0, 1))).sum(2)
        word = np.bincount(index, gap, len(keyed) + 1) + 0.02 * p["word"]
        word[0] = 0
        adam.step({"word": word, "common": np.array([gap.sum()]), "steps": both - real + p["steps"]})
    field = Field(words[keyed], p["common"][0] + p["word"][1:], float(p["common"][0]), p["steps"], np.zeros(3))
    most, total = per_text(marginals(field.weigh(w), at, field.steps), at)
    field.score = calibrate(np.stack([np.ones(len(label)), most, np.log1p(total)]), label) + [shift, 0, 0]
    return field


def calibrate(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A logistic function by Newton's method, lightly held to 0 but for its constant."""
    s = np.zeros(len(x))
    hold = np.diag([1e-6, *[0.1] * (len(x) - 1)])
    for _ in range(50):
        p = sigmoid(s @ x)
        s = s - np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + hold, x @ (p - label) + hold @ s)
    return s


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FITTED) -> Field:
    return fit(*sample(docs, labels, "toxic", MODULUS, HELD_OUT, most))


def score(docs: DataFrame, field: Field, column: str = "text") -> DataFrame:
    """Adds toxic_score and toxic_spans (array of byte offsets: start, end, start, end ...) to documents, with __ before their names where
    there are such columns already."""
    held = docs.sparkSession.sparkContext.broadcast(field)  # about 1 MB, whatever the input
    names = docs.columns
    new = free(["toxic_score", "toxic_spans"], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(column), SLICE):
                s, found = f.tag(buf, off)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(s), pa.array(found, pa.list_(pa.int64()))], names=[*names, *new])

    return docs.mapInArrow(run, schema_of(docs, f"`{new[0]}` double", f"`{new[1]}` array<bigint>"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, prediction and offending offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
