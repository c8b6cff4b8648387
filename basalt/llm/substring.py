"""Substring dedup: words in windows of WINDOW words that also start elsewhere are removed.

A suffix automaton of a reference shard gives matching statistics of what is streamed through it. Where the corpus is its own
reference, automata of all shards cannot be sent to all documents: they grow with the input. So a window is sent to
the one shard that can hold its like. Every window has an anchor, the least hash of its runs of ANCHOR words; equal windows
have equal anchors. Consecutive windows of one anchor are a fragment. Anchors that occur once end here. Equal
fragments are counted, not compared: their windows occur elsewhere. The fragments of an anchor with several different ones
are a shard: their automaton over the words themselves, with the fragments' counts, is built in the task and they are streamed
through it. An anchor with more than SHARD_WORDS words of different fragments is dealt out again by whole windows.

Fragments are known by 128 bits, the anchor's and their own, of two hashes of each word that have nothing to do with each other;
windows that are dealt out by two such hashes too. Two windows are taken for one by mistake with a chance of 2^-128 a pair, or
2^-64 a pair of fragments that do share their anchor's words.

`against` broadcasts automata of a given reference of bounded size.

Defined results: null and empty texts have no words and the empty kept text; texts of fewer than WINDOW words lose
nothing; rows that repeat, even whole, count as documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton, covered
from .base import Scratch, buckets_for, table, text_slices
from .linking import pick
from .words import MIX1, hashes, mix, runs, words

WINDOW, ANCHOR = 35, 10
SHARD_WORDS = 1 << 14
#: Words of the shards whose automaton is built at once.
AUTOMATON_WORDS = 1 << 15
#: The most words of a reference whose automata are broadcast.
MOST_REFERENCE = 1 << 21
#: The seed of the other hash of a word.
OTHER = 0x2545F491
#: Words of fragments whose hashes are made at once.
AT_ONCE = 1 << 19


def fragments(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of many texts: each fragment's anchor, hash, text, first word (in its text), number of words, and whether its anchor
    occurs in it twice, so that it may repeat a window itself."""
    start, end, at = words(buf, off)
    n = len(start)
    none = np.zeros(0, np.int64)
    empty = (none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool))
    if n < window:
        return empty
    grams = least = runs(hashes(buf, start, end), anchor)
    width, done = window - anchor + 1, 1
    while done < width:  # minima over 1, 2, 4 ... neighbours, then the rest
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    j = np.flatnonzero(np.arange(n - window + 1) + window <= at[1:][doc[: n - window + 1]])
    if not len(j):
        return empty
    m = least[j]
    new = np.concatenate(([True], (j[1:] != j[:-1] + 1) | (m[1:] != m[:-1])))
    k = np.flatnonzero(new)
    a, b = j[k], j[np.concatenate((k[1:], [len(j)])) - 1] + window
    size = b - a - anchor + 1
    bounds = np.cumsum(size) - size
    same = grams[np.arange(size.sum()) + np.repeat(a - bounds, size)] == np.repeat(m[k], size)
    return m[k], _digests(hashes(buf, start, end, OTHER), a, b), doc[a], a - at[:-1][doc[a]], b - a, np.add.reduceat(same, bounds, dtype=np.int64) > 1


def _digests(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of h[a:b] for each pair of places, from each word's hash mixed with its place."""
    out, size = np.empty(len(a), np.uint64), b - a
    total = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE)))
        n = size[i:j]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        out[i:j] = np.add.reduceat(mix(h[place + np.repeat(a[i:j], n)] + place.astype(np.uint64) * MIX1), first)
        i = j
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """Every fragment of documents (r, d, text): anchor a, hash f, the row's r and d, and p: first word, number of words
    and, in the lowest bit, whether its anchor occurs in it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column("r").to_numpy()
            for i, _, buf, off in text_slices(batch.column("text")):
                a, f, doc, s, k, again = fragments(buf, off)
                row = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(f.view(np.int64)), pa.array(r[i + doc]), batch.column("d").take(row), pa.array(s << 32 | k << 1 | again)], names=["a", "f", "r", "d", "p"])

    return docs.select("r", "d", "text").mapInArrow(run, "a bigint, f bigint, r bigint, d bigint, p bigint")


def _first(p: str) -> Column:
    return F.shiftright(p, 32)


def _count(p: str) -> Column:
    return F.shiftright(F.col(p).bitwiseAND(0xFFFFFFFF), 1)


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of fragments (a, f, n, heavy, r, d, s, k) found at word s of row r, d."""
    lists = wanted.groupBy("r", "d").agg(F.collect_list(F.struct("a", "f", "n", "heavy", "s", "k")).alias("want"))
    lists = lists.select(F.col("r").alias("__r"), F.col("d").alias("__d"), "want")
    found = pick(docs, wanted.select("r").distinct(), "r").join(lists, (F.col("r") == F.col("__r")) & F.col("d").eqNullSafe(F.col("__d"))).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want").to_pylist()
            for i, j, buf, off in text_slices(batch.column("text")):
                start, end, at = words(buf, off)
                raw, rows = buf.tobytes(), []
                for d, base in zip(range(i, j), at[:-1].tolist()):
                    rows += [(x["a"], x["f"], x["n"], x["heavy"], raw[start[base + x["s"]] : end[base + x["s"] + x["k"] - 1]]) for x in want[d]]
                if rows:
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["a", "f", "n", "heavy", "words"])

    return found.mapInArrow(run, "a bigint, f bigint, n bigint, heavy boolean, words binary")


def _shards(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of fragments (a, f, n, words) whose windows occur twice among their anchor's fragments. Anchors come
    together and in order, as many to an automaton as AUTOMATON_WORDS allows."""

    def solve(held: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        sequences = [x[3].split() for x in held]
        for x, q in zip(held, sequences):
            automaton.add(q, x[2])
        for x, q in zip(held, sequences):
            if x[2] == 1:
                for s, e in covered([c > 1 for c in automaton.windows(q, window)], window):
                    yield x[0], x[1], s, e - s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def out() -> pa.RecordBatch:
            found = list(zip(*solve(held))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "f", "o", "l"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "f", "n", "words"))):
                if row[0] != last and size >= AUTOMATON_WORDS:
                    yield out()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += row[3].count(b" ") + 1
        if held:
            yield out()

    return rows.select("a", "f", "n", "words").repartition("a").sortWithinPartitions("a", "f").mapInArrow(run, "a bigint, f bigint, o bigint, l bigint")


def _pieces(kind: int, to: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Columns of 64-bit numbers dealt into buckets: kind, bucket, bytes."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))).tolist() if len(to) else [0]
    table = np.stack([c.view(np.int64)[order] for c in columns])
    return [(kind, int(to[i]), table[:, i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]


def _piece_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["kind", "bucket", "data"])


def _each_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """A bucket's pieces together, from rows in the order of buckets."""
    last, held = None, []
    for batch in batches:
        for q, d in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
            if q != last and held:
                yield np.concatenate(held, axis=1)
                held = []
            last = q
            held.append(np.frombuffer(d, np.int64).reshape(columns, -1))
    if held:
        yield np.concatenate(held, axis=1)


def _firsts(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a new pair begins, of pairs in order."""
    return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))


def _by_windows(rows: DataFrame, scratch: Scratch, buckets: int, window: int = WINDOW) -> DataFrame:
    """The same for anchors too heavy for one task: windows are dealt out each by itself, in packed pieces.

    What windows of a batch are equal is found in the batch, and one of them goes on for all: a window that very many
    fragments have takes no more room in a task than there are batches."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, f, n = (batch.column(c).to_numpy() for c in ("a", "f", "n"))
            _, _, buf, off = next(text_slices(batch.column("words"), 1 << 62))
            start, end, at = words(buf, off)
            count = np.diff(at) - window + 1
            g = np.repeat(np.arange(len(count)), count)
            i = at[:-1][g] + np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
            o = i - at[:-1][g]
            key, check = (runs(hashes(buf, start, end, seed), window)[i] for seed in (0, OTHER))
            order = np.lexsort((check, key))
            key, check, g, o = key[order], check[order], g[order], o[order]
            first = _firsts(key, check)
            total = np.add.reduceat(n[g], first)
            hit = (np.repeat(total, np.diff(np.concatenate((first, [len(key)])))) > 1) & (n[g] == 1)
            out = _pieces(0, f[g[hit]] % buckets, a[g[hit]], f[g[hit]], o[hit])
            out += _pieces(1, (key[first] % np.uint64(buckets)).astype(np.int64), key[first], check[first], np.minimum(total, 2), a[g[first]], f[g[first]], o[first])
            yield _piece_rows(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, check, weight, a, f, o in _each_bucket(batches, 6):
            order = np.lexsort((check, key))
            key, check, weight, a, f, o = (x[order] for x in (key, check, weight, a, f, o))
            first = _firsts(key, check)
            hit = (np.repeat(np.add.reduceat(weight, first), np.diff(np.concatenate((first, [len(key)])))) > 1) & (weight == 1)
            yield _piece_rows(_pieces(0, f[hit] % buckets, a[hit], f[hit], o[hit]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _each_bucket(batches, 3):
            order = np.lexsort(found[::-1])
            a, f, o = found[:, order]
            # A span ends where the next window is another fragment's or begins beyond it.
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (f[1:] != f[:-1]) | (o[1:] > o[:-1] + window)))
            k = np.flatnonzero(new)
            end = o[np.concatenate((k[1:], [len(o)])) - 1] + window
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[k], f[k], o[k], end - o[k])], names=["a", "f", "o", "l"])

    packed = "kind int, bucket int, data binary"
    sent = scratch.keep(rows.select("a", "f", "n", "words").mapInArrow(emit, packed), "windows")
    met = sent.where("kind = 1").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, packed)
    hits = sent.where("kind = 0").union(met)
    return hits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(spans, "a bigint, f bigint, o bigint, l bigint")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """r, d and spans (array of start and number of words) of every row (r, d, text) with words to remove."""
    occ = scratch.keep(occurrences(docs), "occurrences")
    one = occ.groupBy("a", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "d", "p")).alias("at"))
    one = one.select("a", "f", "n", "at.r", "at.d", "at.p", _count("at.p").alias("k"), (F.col("at.p") % 2 == 1).alias("again"))
    per = one.groupBy("a").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("size"), F.max("again").alias("any")).where("total > 1 or any")
    known = scratch.keep(one.join(per.select("a", "kinds", "size"), "a").withColumn("heavy", F.col("size") > SHARD_WORDS).drop("size"), "repeated")
    wanted = known.where("kinds > 1 or (n = 1 and again)").select("a", "f", "n", "heavy", "r", "d", _first("p").alias("s"), "k")
    held = scratch.keep(_contents(docs, wanted).dropDuplicates(["a", "f"]), "contents")
    whole = known.where("n > 1").select("a", "f", F.lit(0).cast("bigint").alias("o"), F.col("k").alias("l"))
    found = whole.union(_shards(held.where("not heavy"))).union(_by_windows(held.where("heavy"), scratch, buckets_for(docs)))
    found = scratch.keep(found, "found")
    scratch.drop(known, held)
    spans = occ.join(found, ["a", "f"]).select("r", "d", F.struct((_first("p") + F.col("o")).alias("s"), F.col("l").alias("l")).alias("x"))
    out = scratch.keep(spans.groupBy("r", "d").agg(F.collect_set("x").alias("spans")), "spans")
    scratch.drop(found, occ)
    return out


def removed(text: str, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Number of words, how many are removed, and the kept ones joined by a space."""
    w = text.encode().split()
    if not spans:
        return len(w), 0, b" ".join(w)
    gone = np.zeros(len(w) + 1, np.int32)
    for x in spans:
        gone[x["s"]] += 1
        gone[x["s"] + x["l"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(w), int(len(w) - keep.sum()), b" ".join([x for x, k in zip(w, keep.tolist()) if k])


def substring_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (or its SHA-256) of every row of documents."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("r", F.xxhash64("text"))
    spans = repeated_spans(rows.select("r", F.col("doc_id").alias("d"), "text"), scratch).withColumnRenamed("r", "__r")
    joined = rows.join(spans, (F.col("r") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "spans")
    name = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [removed(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            kept = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")


def against(docs: DataFrame, reference: list[str], window: int = WINDOW) -> DataFrame:
    """doc_id and text without the words in windows that occur in the reference, whose shards' automata are broadcast.
    The reference may have MOST_REFERENCE words at most."""
    texts = [t.encode().split() for t in reference if t]
    if sum(map(len, texts)) > MOST_REFERENCE:
        raise ValueError("the reference is too large to be broadcast; use substring_dedup over both")
    shards, size = [SuffixAutomaton()], 0
    for t in texts:
        if size > AUTOMATON_WORDS:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(t)
        size += len(t)
    for s in shards:
        s.occurrences()
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t in batch.column("text").to_pylist():
                w = (t or "").encode().split()
                hits = np.zeros(max(0, len(w) - window + 1), bool)
                for s in held.value if len(hits) else ():
                    hits |= np.array(s.windows(w, window)) > 0
                kept.append(removed(t or "", [{"s": s, "l": e - s} for s, e in covered(hits, window)])[2].decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kept string")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as digests."""
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, j, array_to_string(list_slice(w, j, j + {WINDOW - 1}), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS j)),
dup AS (SELECT r, j FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(j, j + {WINDOW})) AS k FROM dup),
kept AS (SELECT q.r, string_agg(q.x, ' ' ORDER BY q.k) AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d) q WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = q.r AND g.k = q.k) GROUP BY q.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, (SELECT count(*) FROM gone g WHERE g.r = d.r) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
