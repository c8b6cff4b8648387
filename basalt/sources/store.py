"""The four datasets as Parquet, partitioned by height."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten
from ..operators.ledger import Ledger
from . import raw
from .schemas import DATASETS


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """By declared schema, columns in its order: the height comes from the path, which would else put it last."""
    path = f"{root}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], DATASETS[name])
    return spark.read.schema(DATASETS[name]).parquet(path).select(*DATASETS[name].fieldNames())


def read_ledger(spark: SparkSession, root: str) -> Ledger:
    return Ledger(*(read_dataset(spark, root, n) for n in DATASETS))


def register_views(spark: SparkSession, root: str) -> None:
    for n in DATASETS:
        read_dataset(spark, root, n).createOrReplaceTempView(n)


def write_dataset(df: DataFrame, root: str, name: str) -> None:
    """Replaces the partitions of the heights in df, and no others."""
    out = df.select(*DATASETS[name].fieldNames()).repartition("block_height")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_height").parquet(f"{root}/{name}")


def heights(spark: SparkSession, root: str, name: str) -> set[int]:
    """Heights that have a partition, from the folder's listing alone."""
    path = f"{root}/{name}"
    if not _exists(spark, path):
        return set()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [s.getPath().getName() for s in found]
    return {int(n.removeprefix("block_height=")) for n in names if n.startswith("block_height=")}


def complete_heights(spark: SparkSession, root: str) -> set[int]:
    """Heights built in full. A height's marker is written after its four partitions, so one that a lost job left half
    built is built again; the marker's own folder is a dataset of markers."""
    return set.intersection(*(heights(spark, root, n) for n in [*DATASETS, "_complete"]))


def plan(wanted: list[int] | None, found: set[int], done: set[int]) -> dict[str, list[int]]:
    """Of the heights asked for (all that are found, without any): skipped, as they are done, missing_raw, and todo."""
    asked = sorted(found) if wanted is None else sorted(set(wanted))
    return {"skipped": [h for h in asked if h in done], "missing_raw": [h for h in asked if h not in done and h not in found], "todo": [h for h in asked if h in found and h not in done]}


def build(spark: SparkSession, raw_root: str, root: str, wanted: list[int] | None = None, force: bool = False) -> dict[str, list[int]]:
    """Flattens raw heights into the datasets, all of them in one job per dataset.

    Only files of heights still to build are read, each once: what is parsed of them is written beside the datasets, and all else is made
    from there. Gives created, skipped (complete already), missing_raw and failed (a required field is missing, or the folder's block
    is of another height), height by height."""
    found = raw.heights_with(spark, raw_root, "block.json") & raw.heights_with(spark, raw_root, "txs.jsonl")
    out = plan(wanted, found, set() if force else complete_heights(spark, root))
    todo = out.pop("todo")
    if not todo:
        return out | {"failed": [], "created": []}
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    try:
        b = raw.read_blocks(spark, raw_root, todo).withColumn("folder_height", raw.folder_height())
        b.withColumn("bad", F.coalesce(flatten.missing_block_field() | (F.col("height") != F.col("folder_height")), F.lit(True))).write.parquet(f"{staged}/blocks")
        t = raw.read_ordered_transactions(spark, raw_root, todo)
        t.withColumn("bad", flatten.missing_tx_field()).write.parquet(f"{staged}/transactions")
        b, t = (spark.read.parquet(f"{staged}/{n}") for n in ("blocks", "transactions"))
        bad = {r[0] for x in (b, t) for r in x.where("bad").select("folder_height").distinct().collect()}
        bad |= set(todo) - {r[0] for r in b.select("folder_height").collect()}
        good = [h for h in todo if h not in bad]
        out |= {"failed": sorted(bad & set(todo)), "created": good}
        if good:
            _write(spark, root, b.where(~F.col("folder_height").isin(sorted(bad))), t.where(~F.col("folder_height").isin(sorted(bad))), good)
        return out
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _write(spark: SparkSession, root: str, b: DataFrame, t: DataFrame, good: list[int]) -> None:
    t = t.withColumnRenamed("folder_height", "block_height")
    t = t.join(F.broadcast(b.select(F.col("height").alias("block_height"), F.col("id").alias("block_hash"))), "block_height")  # a row per height of this call
    write_dataset(flatten.blocks(b), root, "blocks")
    write_dataset(flatten.transactions(t), root, "transactions")
    write_dataset(flatten.inputs(t), root, "inputs")
    write_dataset(flatten.outputs(t), root, "outputs")
    marks = spark.createDataFrame([(h, True) for h in good], "block_height bigint, done boolean")
    marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_height").parquet(f"{root}/_complete")


def row_counts(spark: SparkSession, root: str) -> dict[str, dict[int, int]]:
    return {n: {r[0]: r[1] for r in read_dataset(spark, root, n).groupBy("block_height").count().collect()} for n in DATASETS}
