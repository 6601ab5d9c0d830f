"""Ranks and running sums over a whole table, without a window that one task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, spread

ONE_WINDOW = 65536  # rows that a single window may order; results are the same beyond it


def bucket_offsets(per_bucket: DataFrame, group: list[str], bucket: str, sums: dict[str, str], buckets: int = ONE_WINDOW) -> DataFrame:
    """Exclusive running sums of each group's buckets: per_bucket has one row per (group, bucket).

    ``buckets`` is how many a group may have: above ONE_WINDOW they are summed in runs of
    so many, then the runs' totals, so that no window holds more rows than that.
    """
    back = lambda *by: W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    if buckets <= ONE_WINDOW:
        return per_bucket.select(*group, bucket, *[F.coalesce(F.sum(c).over(back(*group)), F.lit(0)).alias(out) for c, out in sums.items()])
    run = f"_run{bucket}"
    runs = per_bucket.withColumn(run, F.floor(F.col(bucket) / ONE_WINDOW).cast("long"))
    totals = runs.groupBy(*group, run).agg(*[F.sum(c).alias(c) for c in sums])
    before = bucket_offsets(totals, group, run, {c: f"{run}{c}" for c in sums}, -(-buckets // ONE_WINDOW))
    inside = runs.select(*group, bucket, run, *[F.coalesce(F.sum(c).over(back(*group, run)), F.lit(0)).alias(out) for c, out in sums.items()])
    return inside.join(before, [*group, run]).select(*group, bucket, *[(F.col(out) + F.col(f"{run}{c}")).alias(out) for c, out in sums.items()])


def ranked(df: DataFrame, order: list[Column], rank: str, scratch: Scratch, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None) -> DataFrame:
    """df with a 0-based global rank, exclusive running sums and exclusive running maxima (null before the first row) in the given order.

    A table of up to ONE_WINDOW rows is one window. The rows of a larger one are
    range-partitioned and frozen; each partition is ranked alone and shifted by what
    the partitions before it hold, so that only one row per partition meets in a window.
    """
    sums, maxima = sums or {}, maxima or {}
    if df.limit(ONE_WINDOW + 1).count() <= ONE_WINDOW:
        w = W.partitionBy(F.lit(0)).orderBy(*order)
        back = w.rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", (F.row_number().over(w) - 1).cast("long").alias(rank), *[F.coalesce(F.sum(c).over(back), F.lit(0)).alias(name) for c, name in sums.items()], *[F.max(c).over(back).alias(name) for c, name in maxima.items()])
    part = scratch.save(df.repartitionByRange(spread(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    per = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums], *[F.max(c).alias(f"_m_{c}") for c in maxima])
    earlier = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s0_{c}") for c in sums], *[F.max(f"_m_{c}").over(earlier).alias(f"_m0_{c}") for c in maxima])
    w = W.partitionBy("_part").orderBy(*order)
    back = w.rowsBetween(W.unboundedPreceding, -1)
    out = part.join(before, "_part").withColumn(rank, F.row_number().over(w) - 1 + F.col("_n0"))
    for c, name in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(back), F.lit(0)) + F.col(f"_s0_{c}"))
    for c, name in maxima.items():
        out = out.withColumn(name, F.greatest(F.max(c).over(back), f"_m0_{c}"))
    return out.drop("_part", "_n0", *[f"_s0_{c}" for c in sums], *[f"_m0_{c}" for c in maxima])
