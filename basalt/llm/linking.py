"""From band keys to components: candidates by shared keys, exact Jaccard on full sets, union-find.

Two nodes are candidates where they share a key. In each key's bucket every member is compared with the bucket's
least id. Where that leaves several components in a bucket of three or more, all its pairs of different components
are compared too, block by block inside tasks that give back links alone. So no link between candidates is
lost, no pairs within a bucket are written out, and what a task holds is some BLOCK_SHINGLES. Members are dealt into blocks
by hashes, from sums that are combined before they are shuffled: no task sees a whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch
from .components import components
from .shingles import similar

#: Shingles of the sets of a block; every set counts SET_LEAST more.
BLOCK_SHINGLES, SET_LEAST = 1 << 17, 128
#: Columns of the 0/1 matrix that is multiplied at once.
COLUMNS = 4096
#: Pairs whose sets are open at once, and bytes that their sets have at most, but for a single pair.
PAIRS, PAIR_BYTES = 1024, 1 << 22
#: Sets of a block up to which they are compared pair by pair.
FEW = 12
#: So many ids (8 bytes each) are broadcast at most to pick rows; beyond, they are joined.
MOST_BROADCAST = 1_000_000


def pick(df: DataFrame, ids: DataFrame, on: str = "id", how: str = "left_semi") -> DataFrame:
    """Rows of df whose id is among ids (one column, no repetition), or is not."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id"))
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    return df.join(ids, df[on] == F.col("__id"), how)


Opened = Callable[[pa.Array], list[np.ndarray]]
#: Of two sets as they are shipped: whether they are similar, without hashes.
Exact = Callable[[bytes, bytes], bool]


def verified(pairs: DataFrame, sets: DataFrame, percent: int, opened: Opened, exact: Exact | None = None) -> DataFrame:
    """Pairs u, v whose sets are similar; of those that are by their numbers, exact has the last word."""
    a = sets.select(F.col("id").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("set").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab"))
            k = 0
            while k < batch.num_rows:
                most = int(np.searchsorted(filled, (filled[k - 1] if k else 0) + PAIR_BYTES, "right")) - k
                part = batch.slice(k, min(PAIRS, max(most, 1)))
                k += part.num_rows
                # Equal sets are opened once; an id may have several.
                both = pa.concat_arrays([part.column("a"), part.column("b")]).dictionary_encode()
                held = opened(both.dictionary)
                p, q = both.indices.to_numpy().reshape(2, -1).tolist()
                keep = [similar(held[i], held[j], percent) and (exact is None or exact(both.dictionary[i].as_py(), both.dictionary[j].as_py())) for i, j in zip(p, q)]
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def links(sets: list[np.ndarray], root: list[int], percent: int, exact: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different roots; sets of one root count as linked already. exact: whether sets
    of these places are similar, asked of those that are by their numbers."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    top = int(often.sum())
    for c in range(0, top, COLUMNS):
        i, j = np.searchsorted(column, (c, c + COLUMNS))
        x = np.zeros((n, min(COLUMNS, top - c)), np.float32)
        x[row[i:j], column[i:j] - c] = 1
        both += x @ x.T
    inter = both.astype(np.int64)
    r = np.array(root)
    ok = (100 * inter >= percent * (size[:, None] + size[None, :] - inter)) & (r[:, None] != r[None, :])
    parent = {x: x for x in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(np.triu(ok, 1)))):
        a, b = find(root[i]), find(root[j])
        if a != b and (exact is None or exact(i, j)):
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _dealt(m: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, root and block of members (key, id, root, size). The members of a large root have blocks of their own, those of
    small ones are together, a root in one block."""
    per = scratch.keep(m.groupBy("key", "root").agg(F.sum(F.col("size") + SET_LEAST).alias("w")), "weights")
    small = per.where(F.col("w") <= BLOCK_SHINGLES).groupBy("key").agg(F.ceil(F.sum("w") / BLOCK_SHINGLES).alias("pools"))
    per = scratch.keep(per.join(scratch.keep(small, "pools"), "key", "left"), "dealt")
    joined = m.join(per, ["key", "root"])
    own = F.xxhash64("root", F.pmod(F.xxhash64("id"), F.ceil(F.col("w") / BLOCK_SHINGLES)))
    pool = F.pmod(F.xxhash64("root"), F.col("pools"))
    return joined.select("key", "id", "root", F.when(F.col("w") > BLOCK_SHINGLES, own).otherwise(pool).alias("block"))


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, opened: Opened, unit: int, exact: Exact | None) -> DataFrame:
    """Links in buckets of several components."""
    m = members.select("key", "id").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    m = scratch.keep(m, "large")
    mixed = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    # Buckets of equal members are looked at once.
    mixed = mixed.where("lo <> hi").groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key")
    sized = sets.select("id", (F.octet_length("set") / unit).cast("bigint").alias("size"))
    m = scratch.keep(_dealt(scratch.keep(m.join(mixed, "key").join(sized, "id"), "sized"), scratch), "mixed")
    blocks = scratch.keep(m.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "blocks")
    a, b = (blocks.select(F.col("key").alias(f"{s}k"), F.col("block").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")) for s in "ab")
    two = a.join(b, (F.col("ak") == F.col("bk")) & (F.col("a") <= F.col("b"))).where("not (alo = ahi and blo = bhi and alo = blo)")
    tasks = two.select(F.col("ak").alias("key"), "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    rows = m.join(tasks, ["key", "block"]).join(sets, "id").select(F.xxhash64("key", "a", "b").alias("to"), "key", "a", "b", "id", "root", "set")
    return rows.repartition("to").sortWithinPartitions("to", "key", "a", "b").drop("to").mapInArrow(lambda batches: _linked(batches, percent, opened, exact), "u bigint, v bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of key, a and b, as many together as come in a batch, and where each begins; a group's rows follow each other."""
    held: list[pa.RecordBatch] = []
    last = None

    def cuts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([np.diff(t.column(c).to_numpy()) != 0 for c in ("key", "a", "b")])
        return np.flatnonzero(new)

    def out() -> tuple[pa.Table, list[int]]:
        t = pa.Table.from_batches(held)
        return t, [*cuts(t).tolist(), t.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = cuts(batch)
        names = [tuple(batch.column(c)[i].as_py() for c in ("key", "a", "b")) for i in (0, int(at[-1]))]
        # The last group may go on in the next batch.
        if names[0] == last:
            end = int(at[1]) if len(at) > 1 else batch.num_rows
            held.append(batch.slice(0, end))
            batch = batch.slice(end)
            at = at[1:] - end
        if batch.num_rows:
            if held:
                yield out()
            held = []
            if at[-1]:
                held = [batch.slice(0, int(at[-1]))]
                yield out()
            held = [batch.slice(int(at[-1]))]
        last = names[1]
    if held:
        yield out()


def _linked(batches: Iterator[pa.RecordBatch], percent: int, opened: Opened, exact: Exact | None) -> Iterator[pa.RecordBatch]:
    for t, at in _groups(batches):
        ids, root = t.column("id").to_pylist(), t.column("root").to_pylist()
        found: list[tuple[int, int]] = []
        k = 0
        while k + 1 < len(at):
            # Some groups together: a set that is in several of them is opened once.
            j = k + 1
            while j + 1 < len(at) and at[j + 1] - at[k] <= PAIRS:
                j += 1
            part = t.column("set").slice(at[k], at[j] - at[k]).combine_chunks().dictionary_encode()
            held, which = opened(part.dictionary), part.indices.to_pylist()
            for a, b in zip(at[k:j], at[k + 1 : j + 1]):
                here = which[a - at[k] : b - at[k]]
                same = (lambda x, y, here=here, part=part: exact(part.dictionary[here[x]].as_py(), part.dictionary[here[y]].as_py())) if exact else None
                find = few_links if b - a <= FEW else links
                found += [(ids[a + x], ids[a + y]) for x, y in find([held[x] for x in here], root[a:b], percent, same)]
            k = j
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])


def few_links(sets: list[np.ndarray], root: list[int], percent: int, exact: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """links() pair by pair, for a few sets."""
    root, out = root[:], []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if root[i] != root[j] and similar(sets[i], sets[j], percent) and (exact is None or exact(i, j)):
                out.append((i, j))
                old, new = root[j], root[i]
                root = [new if r == old else r for r in root]
    return out


def link(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, opened: Opened, unit: int, exact: Exact | None = None) -> DataFrame:
    """id and root of every linked node that is not itself a root. nodes: id, keys (array<bigint>), ids without repetition; the
    rest as for link_members."""
    b = nodes.select("id", F.explode("keys").alias("key"))
    shared = b.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1")
    members = scratch.keep(b.join(scratch.keep(shared, "shared"), "key"), "members")
    out = link_members(members, members.where("n > 2"), sets_of, percent, scratch, opened, unit, exact)
    scratch.drop(members)
    return out


def link_members(members: DataFrame, large: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, opened: Opened, unit: int, exact: Exact | None = None) -> DataFrame:
    """The same from members (key, id, pivot) of buckets; large has key, id of those of three members or more, once each.
    sets_of: from a table of ids to id, set (binary). opened makes sorted distinct numbers of a column of sets; unit: bytes of a set
    for each of its numbers."""
    pairs = members.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    sets = scratch.keep(sets_of(members.select("id").distinct()), "sets")
    first = scratch.keep(verified(scratch.keep(pairs, "pairs"), sets, percent, opened, exact), "first")
    labels = components(first, scratch)
    second = scratch.keep(_rest(large, labels, sets, percent, scratch, opened, unit, exact), "second")
    out = components(first.union(second), scratch)
    scratch.drop(sets)
    return out
