"""Distributed union-find: connected components of an edge table by alternating large and small stars, with a union-find of each
partition's own edges before and between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch


#: Nodes that a partition's union-find holds; beyond, it gives what it has and begins anew.
MOST_NODES = 1 << 20


def _local(e: DataFrame) -> DataFrame:
    """Edges with the same components as e: every node of a partition, linked to the least one that it is connected to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent[x]) != x:
                parent[x] = parent[p]
                x = p
            return x

        def out() -> pa.RecordBatch:
            found = [(x, r) for x in parent if (r := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                for x in (u, v):
                    parent.setdefault(x, x)
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > MOST_NODES:
                yield out()
                parent.clear()
        yield out()

    return e.mapInArrow(run, "u bigint, v bigint")


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them. Edges have u > v here."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and root (the least id reachable) of every node of edges u, v other than the roots themselves.

    A node of many edges is no hot spot: minima are combined before they are shuffled, and the joins have no
    aggregation above them in their stage, so a large partition may be split. Each round is written to the shared folder."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = scratch.keep(_local(e), "edges"), None
    while True:
        r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == tuple(r) or not r[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen, old = tuple(r), e
        e = scratch.keep(_local(_small(_large(e))), "edges")
        scratch.drop(old)
