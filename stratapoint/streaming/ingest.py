"""Incremental ingest: each micro-batch becomes a cloud of its own (an extension of the batch writer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.cloud import Metadata, write_cloud


def stream_clouds(points: DataFrame, path: str, checkpoint: str, max_points_per_node: int = 100_000, metadata: Metadata | None = None) -> StreamingQuery:
    """Write every non-empty micro-batch below ``path`` as ``batch=N``; a batch that is run again finds its cloud whole and leaves it."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={n}"
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        if not batch.isEmpty() and not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            write_cloud(batch, target, None, max_points_per_node, metadata)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
