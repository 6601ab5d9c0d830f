"""Records that arrive one by one, on the driver or in tasks: kept in the shared folder in bounded batches, and read back as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import DIMENSIONS, selection
from ..model import InvalidInput
from ..operators.scratch import Scratch


class RecordBatches:
    """Records (mappings of dimensions) gathered to batches of at most ``size`` with their ordinal ``idx``."""

    def __init__(self, dimensions: list[str], size: int):
        self.names = selection(dimensions)
        if missing := [a for a in "xyz" if a not in self.names]:
            raise InvalidInput(f"columns {', '.join(missing)} are required")
        self.schema = T.StructType([T.StructField("idx", T.LongType()), *(T.StructField(n, DIMENSIONS[n]) for n in self.names)])
        self.size, self.count, self._keys, self._rows = size, 0, set(self.names), []

    def append(self, record) -> pa.RecordBatch | None:
        """The batch that the record fills, if it fills one."""
        if record.keys() != self._keys:
            raise InvalidInput(f"record {self.count} has other dimensions than the spill")
        self._rows.append((self.count, *(record[n] for n in self.names)))
        self.count += 1
        return self.take() if len(self._rows) >= self.size else None

    def take(self) -> pa.RecordBatch | None:
        """The records since the last batch, if any."""
        if not self._rows:
            return None
        columns = [pa.array(c, from_arrow(f.dataType)) for c, f in zip(zip(*self._rows), self.schema.fields)]
        self._rows = []
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class RecordSpill:
    """Append records (mappings of dimensions), then ``finish`` for a DataFrame of them with their ordinal ``idx``.

    The driver holds one batch at most. All records have the dimensions that the spill was opened with.
    """

    def __init__(self, spark: SparkSession, dimensions: list[str], batch: int = 100_000):
        self._batches = RecordBatches(dimensions, batch)
        self.spark, self.names, self.schema = spark, self._batches.names, self._batches.schema
        self._scratch, self._tables, self._done = Scratch(spark, "records"), [], False

    @property
    def count(self) -> int:
        return self._batches.count

    def append(self, record) -> None:
        if self._done:
            raise InvalidInput("the spill is finished")
        self._save(self._batches.append(record))

    def _save(self, batch: pa.RecordBatch | None) -> None:
        if batch is not None:
            self._tables.append(self._scratch.save(self.spark.createDataFrame(pa.Table.from_batches([batch]), self.schema)))

    def finish(self) -> DataFrame:
        self._save(self._batches.take())
        self._done = True
        if not self._tables:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(t._scratch_path for t in self._tables))

    def drop(self) -> None:
        """Delete what was kept; nothing may read it any more."""
        for t in self._tables:
            self._scratch.drop(t)


def from_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def spill_records(spark: SparkSession, records: Iterable, dimensions: list[str], batch: int = 100_000) -> DataFrame:
    """All records of an iterator as points."""
    spill = RecordSpill(spark, dimensions, batch)
    for r in records:
        spill.append(r)
    return spill.finish()


def _fed(dimensions: list[str], size: int):
    """The rows of a partition, record by record, as batches that name it."""

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), RecordBatches(dimensions, size)
        named = lambda b: b.append_column("_part", pa.array([part] * b.num_rows, pa.int32()))
        for batch in batches:
            for r in batch.to_pylist():
                if (full := own.append(r)) is not None:
                    yield named(full)
        if (rest := own.take()) is not None:
            yield named(rest)

    return feed


def spill_rows(rows: DataFrame, order: str, dimensions: list[str], batch: int = 100_000) -> DataFrame:
    """The rows of a table as points, fed record by record in the given order: each task feeds one range of it.

    A task holds one batch at most; the driver learns only how many records each range has,
    by which the ordinals of its records are shifted.
    """
    own = RecordBatches(dimensions, batch)
    ranges = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(*own.names)
    schema = T.StructType([*own.schema.fields, T.StructField("_part", T.IntegerType())])
    spilled = Scratch(rows.sparkSession, "records").save(ranges.mapInArrow(_fed(dimensions, batch), schema))
    before, n = [], 0
    for r in spilled.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before.append((r["_part"], n))
        n += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    return spilled.join(starts, "_part").select((F.col("idx") + F.col("_before")).alias("idx"), *own.names)
