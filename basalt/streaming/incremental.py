"""Raw heights flattened as they arrive, by Structured Streaming. An extension: each batch is a call of the batch build, so a
batch that runs twice gives the same partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import raw, store
from ..sources.schemas import RAW_BLOCK


def watch(spark: SparkSession, raw_root: str, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follows the block.json files, which a published folder has from the start."""
    arrived = spark.readStream.schema(RAW_BLOCK).option("multiLine", True).json(raw.heights_glob(raw_root, "block.json")).select(F.col("height"))

    def build(batch: DataFrame, _: int) -> None:
        found = [r[0] for r in batch.distinct().collect()]
        if found:
            store.build(batch.sparkSession, raw_root, root, found)

    w = arrived.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
