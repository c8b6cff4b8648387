"""What the corpus operators share: table access, the shared scratch folder, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that numpy code handles at once; longer single texts make longer slices.
SLICE_BYTES = 1 << 21
#: Bytes of input for each bucket; a bucket's rows are held by one Python worker at a time. The number of buckets fits 23 bits: beyond
#: some 500 TB buckets grow.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, (1 << 23) - 1
#: What Spark estimates where it knows nothing is more than this.
UNKNOWN_BYTES = 1 << 60
#: Spark's setting for deleting a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. Only a local session may go without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = getattr(spark.sparkContext, "_basalt_scratch", None)
    if held is None:
        held = spark.sparkContext._basalt_scratch = f"file://{tempfile.mkdtemp(prefix='basalt-')}"
    return held


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation of what is done.

    keep() writes and rereads, and lets Spark delete the write's shuffle files, which nothing reads again; drop() deletes a table
    whose readers have run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        conf = self.spark.conf
        before = conf.get(SHUFFLE_CLEANUP, "false")
        conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of df by Spark's own estimate, from files' sizes; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def buckets_for(df: DataFrame) -> int:
    """How many buckets to deal what is made of df into: some of BUCKET_BYTES of df, and a few for each partition at least."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(input_bytes(df) // BUCKET_BYTES, MOST_BUCKETS))


def free(names: list[str], taken: list[str]) -> list[str]:
    """Names for new columns: with __ before them where there is such a column already."""
    return [f"__{n}" if n in taken else n for n in names]


def schema_of(df: DataFrame, *more: str) -> str:
    """Columns of df and more, as a schema for what a function gives."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, len(col))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def sub_batches(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for a, b, _, _ in text_slices(batch.column(column), limit):
        yield batch.slice(a, b - a)
