"""Intermediate tables in the cluster's shared checkpoint folder.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (the folder all
executors share), so a lost executor costs a re-read and never a re-computation
of an earlier iteration. Parquet also gives later joins a true size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import InvalidInput


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder; where the session names none, a local one on a single machine (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise InvalidInput("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='stratapoint-')}")
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


class Scratch:
    """Tables of one operator run; those not dropped go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df once and give back a DataFrame that reads what was written."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bytes(self, df: DataFrame) -> int:
        """The size of a saved table on disk, known without a job."""
        return self._fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)).getLength()

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def spread(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
