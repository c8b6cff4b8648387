"""Line dedup: fuzzy lines by MinHash over character shingles, one line kept per component.

Lines are the pieces of a text between newlines. Lines that are equal, ASCII lower-cased and without blanks at their ends, are one
node from the start. Signatures are one-permutation MinHash of CHARS-byte shingles: one hash
per shingle, the least in each of BANDS * ROWS bins, empty bins filled by the densification that keeps the chance of a match
at the Jaccard similarity. Bands of it give candidates, exact Jaccard on the full shingle sets confirms links, and
union-find over all links gives components. Of a component the first line stays, that of the least (doc_id, line number);
all others are removed.

A pair at the threshold of 0.8 shares none of the bands with a chance of about (1 - 0.8^6)^20 = 0.2 %; one at 0.9, 4e-7. Lines of
one language that have nothing to do with each other (0.1) share one with a chance of 2e-5, so candidates grow little faster
than lines.

A line's name is 128 bits of its hash, id and check. Candidates carry id alone. Where an id has several checks, its lines
are nodes of their own and candidates of each other, so that no two lines are taken for one by 64 bits alone; shingles are compared
as the bytes they are.

Band keys travel in packed pieces. What lines of a batch share a key is found in the batch, and one of them goes on for all,
so that a key that very many lines share takes no more room in a task than there are batches.

Defined results: blank lines are kept and link with nothing; null texts have no lines and stay null; rows equal in doc_id and text
are one document, other rows of one doc_id are ordered by a hash of their text; null doc_ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .base import Scratch, buckets_for, free, schema_of, table, text_slices
from .linking import link_members, pick
from .words import BLANK, LOWER, MIX1, MIX2, mix

#: A shingle is packed into a 64-bit number, which it fits, so sets are compared exactly. Short, so that one letter changed in
#: a line of 50 bytes leaves 0.8 of them.
CHARS, WIDTH = 5, 8
BANDS, ROWS, PERCENT = 20, 6, 80
#: Draws of the densification before a bin takes the next full one.
DRAWS = 64
SLICE = 1 << 20
#: Shingles that are open at once; longer lines are cut into parts of so many.
PART = 1 << 18
SPREAD = np.uint64(0x9FB21C651E98DF25)
#: Bits of a band key that travel besides its bucket.
KEY_BITS = 40


def normal(line: str) -> str:
    """What of a line counts for equality."""
    return line.strip(" \t\r\x0b\x0c").translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class Lines:
    """The lines of many texts that are not blank: ASCII lower-cased bytes, start and end without blanks, text and number of
    each, and id and check: two halves of its hash. id_bits: how many bits of id are used; tests use few."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, id_bits: int = 64):
        n, docs = len(buf), len(off) - 1
        cut = np.flatnonzero(buf == 10)
        of = np.searchsorted(off, cut, "right") - 1
        before = np.searchsorted(of, np.arange(docs + 1))
        first = np.arange(docs) + before[:-1]
        start, end, doc = (np.empty(docs + len(cut), np.int64) for _ in range(3))
        at = np.arange(len(cut)) + of
        start[at + 1], start[first] = cut + 1, off[:-1]
        end[np.arange(docs) + before[1:]], end[at] = off[1:], cut
        doc = np.repeat(np.arange(docs), np.diff(before) + 1)
        number = np.arange(len(start)) - first[doc]
        solid = np.append(np.flatnonzero(~BLANK[buf]), n)
        start = solid[np.searchsorted(solid, start)]
        last = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
        keep = (start < end) & (last > start)
        self.low = np.concatenate((LOWER[buf], np.full(WIDTH, 255, np.uint8)))
        self.start, self.end, self.doc, self.number = start[keep], last[keep], doc[keep], number[keep]
        digests = b"".join(map(xxh3_128_digest, self.bytes(np.arange(len(self.start)))))
        self.id, self.check = np.frombuffer(digests, np.int64).reshape(-1, 2).T.copy()
        if id_bits < 64:
            self.id &= (1 << id_bits) - 1

    def once(self) -> np.ndarray:
        """Where each line is first."""
        return _first_of(self.id, self.check)

    def bytes(self, k: np.ndarray) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[a:b] for a, b in zip(self.start[k].tolist(), self.end[k].tolist())]


def shingles(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines as numbers, in order and with repetition, and each line's offset. A shorter line is one shingle,
    filled up with bytes that no text has. low has WIDTH bytes beyond the last line."""
    size = end - start
    made = np.maximum(size - CHARS + 1, 1)
    at = np.cumsum(np.concatenate(([0], made)))
    place = np.arange(at[-1]) + np.repeat(start - at[:-1], made)
    low = np.ascontiguousarray(low)
    values = np.ndarray((len(low) - WIDTH + 1,), "<u8", low.data, strides=(1,))[place]
    every = (1 << 8 * CHARS) - 1
    values &= np.uint64(every)
    for k in np.flatnonzero(size < CHARS).tolist():
        values[at[k]] |= np.uint64((-1 << 8 * int(size[k])) & every)
    return values, at


def parts(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lines in groups of some PART shingles, the longer ones in pieces: number of the line, start and end of each piece.
    Every shingle is in one piece."""
    count = np.maximum(end - start - CHARS, 0) // PART + 1
    line = np.repeat(np.arange(len(start)), count)
    k = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    a = start[line] + k * PART
    b = np.minimum(end[line], a + PART + CHARS - 1)
    total = np.cumsum(b - a)
    i = 0
    while i < len(line):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PART)))
        yield line[i:j], a[i:j], b[i:j]
        i = j


def bin_minima(low: np.ndarray, start: np.ndarray, end: np.ndarray, bins: int) -> np.ndarray:
    """The one-permutation signature of each line, densified."""
    n = len(start)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, none, np.uint64)
    for line, a, b in parts(start, end):
        h, at = shingles(low, a, b)
        h *= SPREAD
        h ^= h >> np.uint64(29)
        h *= MIX2
        h ^= h >> np.uint64(32)
        slot = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        slot += np.repeat(line * bins, np.diff(at))
        np.minimum.at(out, slot, h)
    full = out != none
    # An empty bin takes what a bin drawn by its own number holds; all lines draw alike.
    todo = np.flatnonzero(~full)
    for t in range(DRAWS + bins):
        if not len(todo):
            break
        row, b = np.divmod(todo, bins)
        draw = (mix((b * (DRAWS + 1) + t + 1).astype(np.uint64)) % np.uint64(bins)).astype(np.int64) if t < DRAWS else (b + t - DRAWS + 1) % bins
        source = row * bins + draw
        got = full[source]
        out[todo[got]] = out[source[got]]
        todo = todo[~got]
    return out.reshape(-1, bins)


def keys_of(signature: np.ndarray) -> np.ndarray:
    s = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX1, s.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ (s[:, :, r] * MIX2 + np.uint64(r + 1)))
    return key


def open_lines(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingles of each line of a column of bytes."""
    out: list[np.ndarray] = []
    for first, _, buf, off in text_slices(column, SLICE):
        low = np.concatenate((buf, np.full(WIDTH, 255, np.uint8)))
        for line, start, end in parts(off[:-1], off[1:]):
            values, at = shingles(low, start, end)
            # Sorted all at once: a line's number stands above its shingles.
            values |= np.repeat((line - line[0]).astype(np.uint64) << np.uint64(8 * CHARS), np.diff(at))
            values.sort()
            values = values[np.concatenate(([True], values[1:] != values[:-1]))]
            cut = np.searchsorted(values, np.arange(line[-1] - line[0] + 2, dtype=np.uint64) << np.uint64(8 * CHARS)).tolist()
            values &= np.uint64((1 << 8 * CHARS) - 1)
            sets = [values[i:j] for i, j in zip(cut[:-1], cut[1:])]
            if first + int(line[0]) < len(out):
                out[-1] = np.union1d(out[-1], sets.pop(0))
            out += sets
    return out


def contents(docs: DataFrame, ids: DataFrame, id_bits: int = 64) -> DataFrame:
    """id, check and set (the line's bytes, of which its shingles are made where they are compared) of the lines of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_slices(batch.column("text"), SLICE):
                x = Lines(buf, off, id_bits)
                k = x.once()
                yield pa.RecordBatch.from_arrays([pa.array(x.id[k]), pa.array(x.check[k]), pa.array(x.bytes(k), pa.binary())], names=["id", "check", "set"])

    found = docs.select("text").mapInArrow(run, "id bigint, check bigint, `set` binary")
    return pick(found, ids).groupBy("id", "check").agg(F.min("set").alias("set"))


def _stars(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: those of keys that have several ids, sorted, once each, with the least id of their key; then key and least id of each
    key there is, sorted by keys."""
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    least = np.minimum.reduceat(ids, first)
    n = np.diff(np.append(first, len(key)))
    several = np.repeat(n > 1, n)
    k, i, pivot = key[several], ids[several], np.repeat(least, n)[several]
    order = np.lexsort((i, k))
    k, i, pivot = k[order], i[order], pivot[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    k, i, pivot = k[new], i[new], pivot[new]
    # What is left alone after that was one id several times.
    lone = np.ones(len(k), bool)
    lone[1:] &= k[1:] != k[:-1]
    lone[:-1] &= k[1:] != k[:-1]
    return k[~lone], i[~lone], pivot[~lone], key[first], least


def _first_of(i: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where each pair is first."""
    order = np.lexsort((c, i))
    i, c = i[order], c[order]
    new = np.ones(len(order), bool)
    new[1:] = (i[1:] != i[:-1]) | (c[1:] != c[:-1])
    return np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order


def emitted(docs: DataFrame, buckets: int, id_bits: int = 64) -> DataFrame:
    """Packed pieces of rows (r, doc_id, text): in bucket -2 every line's id, check, r, doc_id, whether that is null, and number; in
    bucket -1 key, id and pivot of lines that share a key within a batch; in the others KEY_BITS of the key and id of one line a
    key. A key is its bucket and these bits."""

    def pack(*columns: np.ndarray) -> bytes:
        return np.stack([c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in columns]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, null = batch.column("r").to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_id = batch.column("doc_id").fill_null(0).to_numpy()
            keys, ids, checks, out = [], [], [], []
            for a, _, buf, off in text_slices(batch.column("text"), SLICE):
                x = Lines(buf, off, id_bits)
                if not len(x.id):
                    continue
                row = a + x.doc
                out.append((-2, pack(x.id, x.check, r[row], doc_id[row], null[row], x.number)))
                k = x.once()
                key = keys_of(bin_minima(x.low, x.start[k], x.end[k], BANDS * ROWS)).ravel()
                keys.append((key >> np.uint64(KEY_BITS)) % np.uint64(buckets) << np.uint64(KEY_BITS) | key & np.uint64((1 << KEY_BITS) - 1))
                ids.append(x.id[k])
                checks.append(x.check[k])
            if keys:
                id_ = np.concatenate(ids)
                once = _first_of(id_, np.concatenate(checks))
                shared, members, pivot, key, id_ = _stars(np.concatenate(keys).reshape(-1, BANDS)[once].ravel(), np.repeat(id_[once], BANDS))
                if len(shared):
                    out.append((-1, pack(shared, members, pivot)))
                to = (key >> np.uint64(KEY_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))).tolist()
                low = np.ascontiguousarray(key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
                out += [(int(to[i]), low[i:j].tobytes() + id_[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "data"])

    return docs.select("r", "doc_id", "text").mapInArrow(run, "bucket int, data binary")


def places(packed: DataFrame) -> DataFrame:
    """id, check, r, doc_id and line of every line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column("data"):
                i, c, r, doc, null, line = np.frombuffer(d.as_buffer(), np.int64).reshape(6, -1)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(c), pa.array(r), pa.array(doc, mask=null.astype(bool)), pa.array(line)], names=["id", "check", "r", "doc_id", "line"])

    return packed.where("bucket = -2").select("data").mapInArrow(run, "id bigint, check bigint, r bigint, doc_id bigint, line bigint")


def members_of(packed: DataFrame) -> DataFrame:
    """key, id and pivot of lines that share a band key; an id may come more than once with a key."""

    def rows(key: np.ndarray, ids: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids, pivot)], names=["key", "id", "pivot"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("data"):
                yield rows(*np.frombuffer(p.as_buffer(), np.int64).reshape(3, -1))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        few = KEY_BITS // 8

        def out() -> pa.RecordBatch:
            keys, ids = [], []
            for p in held:
                n = len(p) // (few + 8)
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :few] = np.frombuffer(p, np.uint8, n * few).reshape(n, few)
                keys.append(wide.view("<u8").ravel() | np.uint64(last << KEY_BITS))
                ids.append(np.frombuffer(p, np.int64, n, n * few))
            return rows(*_stars(np.concatenate(keys), np.concatenate(ids))[:3])

        for batch in batches:
            for q, p in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if q != last and held:
                    yield out()
                    held = []
                last = q
                held.append(p)
        if held:
            yield out()

    schema = "key bigint, id bigint, pivot bigint"
    here = packed.where("bucket = -1").mapInArrow(unpack, schema)
    met = packed.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, schema)
    return here.union(met)


class Names:
    """Nodes for lines (id, check): their ids, but for ids that stand for several lines. These have nodes of their own, and a bucket
    in which they meet. kinds: an id's least and greatest check, lo and hi."""

    def __init__(self, where: DataFrame, kinds: DataFrame, scratch: Scratch):
        several = kinds.where("lo <> hi").select("id")
        self.none = not several.limit(1).count()
        if not self.none:
            self.splits = scratch.keep(where.select("id", "check").join(several, "id").distinct().withColumn("node", F.xxhash64("id", "check")), "splits")

    def named(self, df: DataFrame) -> DataFrame:
        """Rows with id and check: id becomes the node, check goes."""
        if self.none:
            return df.drop("check")
        return df.join(self.splits, ["id", "check"], "left").withColumn("id", F.coalesce("node", "id")).drop("check", "node")

    def each(self, df: DataFrame, column: str) -> DataFrame:
        """A row for each node that an id of the column stands for."""
        if self.none:
            return df
        s = self.splits.select(F.col("id").alias("__i"), "node")
        return df.join(s, F.col(column) == F.col("__i"), "left").withColumn(column, F.coalesce("node", column)).drop("__i", "node")

    def members(self, m: DataFrame) -> DataFrame:
        if self.none:
            return m
        own = self.splits.groupBy("id").agg(F.min("node").alias("pivot"))
        own = self.splits.join(own, "id").select(F.xxhash64("id", F.lit("split")).alias("key"), F.col("node").alias("id"), "pivot")
        return self.each(self.each(m, "id"), "pivot").select("key", "id", "pivot").union(own)

    def sets(self, docs: DataFrame, nodes: DataFrame, id_bits: int) -> DataFrame:
        if self.none:
            return contents(docs, nodes, id_bits).drop("check")
        back = self.splits.select(F.col("id").alias("__i"), "node")
        ids = nodes.join(back, nodes["id"] == F.col("node"), "left").select(F.coalesce("__i", "id").alias("id")).distinct()
        return self.named(contents(docs, ids, id_bits)).join(nodes, "id", "left_semi")


def line_spans(docs: DataFrame, percent: int = PERCENT, id_bits: int = 64) -> DataFrame:
    """r, doc_id and lines (array of line numbers) to remove from rows (r, doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "lines")
    packed = scratch.keep(emitted(docs, buckets_for(docs), id_bits), "packed")
    where = scratch.keep(places(packed), "places")
    kinds = scratch.keep(where.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")), "kinds")
    names = Names(where, kinds, scratch)
    members = scratch.keep(names.members(members_of(packed)), "members")
    scratch.drop(packed)
    size = scratch.keep(members.groupBy("key").agg(F.count_distinct("id").alias("n")).where("n > 2").select("key"), "size")
    large = members.join(size, "key", "left_semi").select("key", "id").distinct()
    roots = link_members(members, large, lambda ids: names.sets(docs, ids, id_bits), percent, scratch, open_lines, 1)
    scratch.drop(members)
    # Most lines occur once and are like no other: no place of theirs is of interest.
    wanted = names.each(kinds.where("n > 1").select("id"), "id").union(roots.select("id")).union(roots.select("root")).distinct()
    some = pick(names.named(where), scratch.keep(wanted, "wanted")).drop("__id")
    some = scratch.keep(some.join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), "r", "doc_id", "line"), "rooted")
    place = F.struct("doc_id", "r", "line")
    firsts = scratch.keep(some.groupBy("root").agg(F.count(F.lit(1)).alias("total"), F.min(place).alias("keep")).where("total > 1").select("root", "keep"), "firsts")
    gone = some.join(firsts, "root").where(~place.eqNullSafe(F.col("keep"))).select("r", "doc_id", "line")
    out = scratch.keep(gone.groupBy("r", "doc_id").agg(F.collect_set("line").alias("lines")), "gone")
    scratch.drop(where, kinds, some)
    return out


def line_dedup(docs: DataFrame, percent: int = PERCENT, id_bits: int = 64) -> DataFrame:
    """All columns of documents, with the text that is left, and n_lines, n_removed (with __ before, where there is such a
    column already)."""
    names = docs.columns
    row = F.xxhash64("text")
    gone = line_spans(docs.select(row.alias("r"), "doc_id", "text"), percent, id_bits)
    rows = docs.select(*names, row.alias("__row"))
    gone = gone.select(F.col("r").alias("__gone_row"), F.col("doc_id").alias("__gone_id"), F.col("lines").alias("__lines"))
    joined = rows.join(gone, (F.col("__row") == F.col("__gone_row")) & rows["doc_id"].eqNullSafe(F.col("__gone_id")), "left").select(*names, "__lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for a, b, _, _ in text_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                kept, n, k = [], [], []
                for t, gone in zip(part.column("text").to_pylist(), part.column("__lines").to_pylist()):
                    lines = [] if t is None else t.split("\n")
                    drop = set(gone or ())
                    kept.append(t if not drop else "\n".join([x for i, x in enumerate(lines) if i not in drop]))
                    n.append(len(lines))
                    k.append(len(drop))
                cols = [part.column(c) for c in names]
                cols[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=[*names, *counts])

    counts = free(["n_lines", "n_removed"], names)
    return joined.mapInArrow(run, schema_of(docs, *(f"`{c}` bigint" for c in counts)))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: doc_id, n_lines, n_removed and the SHA-256 of the kept text (null: empty)."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
