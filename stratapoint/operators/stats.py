"""One pass over a cloud: aggregates and the first broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import angle_steps, quantize
from ..functions.schema import UNSIGNED
from ..model import Bounds, InvalidInput


def finite(c: str) -> Column:
    v = F.col(c)
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def bounds_of(points: DataFrame) -> DataFrame:
    """min and max of each axis; NaN is left out."""
    real = lambda a: F.when(~F.isnan(a), F.col(a))
    return points.agg(*[f(real(a)).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def return_histogram(points: DataFrame) -> DataFrame:
    """15 rows: points of return 1 to 15; return 0 is not counted."""
    bins = points.sparkSession.range(1, 16).select(F.col("id").cast("int").alias("return_number"))
    n = points.groupBy(F.col("return_number").cast("int").alias("return_number")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "return_number", "left").select("return_number", F.coalesce("n", F.lit(0)).alias("points"))


def rules(columns: list[str], bounds: Bounds | None, scale: tuple, offset: tuple, extra: int) -> list[tuple[str, Column]]:
    """(message, broken) in the order in which a point is judged."""
    out = [(f"{a} coordinate must be finite", ~finite(a)) for a in "xyz"]
    if bounds:
        out += [(f"{a} lies outside the declared bounds", ~F.coalesce((F.col(a) >= lo) & (F.col(a) <= hi), F.lit(False))) for a, lo, hi in zip("xyz", bounds.min, bounds.max)]
    out += [(f"{a} is outside LAS i32 range", quantize(F.col(a), s, o).isNull()) for a, s, o in zip("xyz", scale, offset)]
    if "scan_angle" in columns:
        out.append(("scan_angle must be finite and fit 16 bits", ~finite("scan_angle") | angle_steps(F.col("scan_angle")).isNull()))
    out += [(f"{c} must be 0..{2**bits - 1}", ~F.coalesce(F.col(c).between(0, 2**bits - 1), F.lit(False))) for c, bits in UNSIGNED.items() if c in columns]
    out += [(f"{c} must be 0 or 1", ~F.coalesce(F.col(c).cast("int").between(0, 1), F.lit(False))) for c in ("synthetic", "key_point", "withheld", "overlap", "scan_direction_flag", "edge_of_flight_line") if c in columns]
    if "gps_time" in columns:
        out.append(("GPS time must be finite", ~finite("gps_time")))
    if extra:
        out.append((f"extra byte(s), expected {extra}", F.coalesce(F.octet_length("extra_bytes"), F.lit(-1)) != extra))
    return out


def validate(points: DataFrame, bounds: Bounds | None, scale: tuple, offset: tuple, extra: int = 0, ordinal: str = "idx"):
    """Raise for the point with the lowest ordinal that breaks a rule, and its first rule; else return the statistics row."""
    if bounds:
        bounds.check()
    for s, o in zip(scale, offset):
        if not (0 < s < float("inf")) or o != o or abs(o) == float("inf"):
            raise InvalidInput("scale must be finite and positive, offset finite")
    told = rules(points.columns, bounds, scale, offset, extra)
    broken = F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(told)])
    gps = "gps_time" in points.columns
    row = points.withColumn("_rule", broken).agg(
        F.min(F.when(F.col("_rule").isNotNull(), F.struct(F.col(ordinal).alias("i"), F.col("_rule").alias("rule")))).alias("bad"), F.count(F.lit(1)).alias("n"),
        *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))],
        *([F.min("gps_time").alias("gps_min"), F.max("gps_time").alias("gps_max")] if gps else [F.lit(0.0).alias("gps_min"), F.lit(0.0).alias("gps_max")]),
        *([F.count(F.when(F.col("return_number") == k, 1)).alias(f"return_{k}") for k in range(1, 16)] if "return_number" in points.columns else []),
    ).first()
    if not row["n"]:
        raise InvalidInput("cannot write empty cloud")
    if row["bad"]:
        raise InvalidInput(f"point {row['bad']['i']}: {told[row['bad']['rule']][0]}")
    return row


def violations(points: DataFrame, bounds: Bounds | None, scale: tuple, offset: tuple, extra: int = 0) -> DataFrame:
    """One row per rule: how many points break it."""
    told = rules(points.columns, bounds, scale, offset, extra)
    row = points.agg(*[F.count(F.when(test, 1)).alias(str(i)) for i, (_, test) in enumerate(told)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("rule"), F.col(str(i)).alias("broken")) for i, (m, _) in enumerate(told)])).alias("r")).select("r.*")
