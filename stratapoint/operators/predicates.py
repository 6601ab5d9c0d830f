"""The query language as Column predicates: closed boxes, level ranges, node pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Bounds, InvalidData, PointQuery


def in_box(b: Bounds | None, x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Six comparisons that reach the Parquet scan; NaN is in no box."""
    if b is None:
        return F.lit(True)
    tests = [(F.col(c) >= lo) & (F.col(c) <= hi) for c, lo, hi in zip((x, y, z), b.min, b.max)]
    return reduce(lambda p, q: p & q, tests)


def in_levels(q: PointQuery, spacing: float) -> Column:
    low, high = q.lod.levels(spacing)
    return (F.col("level") >= low) & (F.col("level") < high)


def voxel_box(center: tuple[float, float, float], half: float) -> dict[str, Column]:
    """min and max columns of a node's box from its key: root corner plus key times side."""
    side = F.lit(half * 2.0) / F.pow(F.lit(2.0), F.col("level"))
    out = {}
    for axis, c in zip("xyz", center):
        lo = F.lit(c - half) + F.col(f"k{axis}") * side
        out |= {f"{axis}min": lo, f"{axis}max": lo + side}
    return out


def node_meets(b: Bounds | None, center: tuple[float, float, float], half: float) -> Column:
    """Whether a node's box touches the query box."""
    if b is None:
        return F.lit(True)
    box = voxel_box(center, half)
    return reduce(lambda p, q: p & q, [(box[f"{a}min"] <= hi) & (box[f"{a}max"] >= lo) for a, lo, hi in zip("xyz", b.min, b.max)])


def selected_nodes(hierarchy: DataFrame, q: PointQuery, center: tuple[float, float, float], half: float, spacing: float) -> DataFrame:
    """Nodes that a query has to read, in stored order: with points, in its levels, touching its box."""
    bad = hierarchy.filter("point_count < -1 or (point_count > 0 and byte_size <= 0)" + (" or least(level, kx, ky, kz) < 0" if q.bounds else "")).first()
    if bad:
        raise InvalidData(f"hierarchy row {bad.asDict()} is not valid")
    return hierarchy.filter((F.col("point_count") > 0) & in_levels(q, spacing) & node_meets(q.bounds, center, half)).orderBy("offset", "level", "kx", "ky", "kz")


def entry_kind() -> Column:
    n = F.col("point_count")
    return F.when(n == -1, "page").when(n == 0, "empty").when(n > 0, "points").otherwise("error")


def page_matches(q: PointQuery, center: tuple[float, float, float], half: float, spacing: float) -> Column:
    """Whether the page below a pointer may hold selected nodes; negative keys are always loaded."""
    _, high = q.lod.levels(spacing)
    return (F.least("level", "kx", "ky", "kz") < 0) | ((F.col("level") < high) & node_meets(q.bounds, center, half))


def below(level: int, x: int, y: int, z: int) -> Column:
    """Whether a node is the given one or below it."""
    up = F.col("level") - level
    shifted = [F.floor(F.col(f"k{a}") / F.pow(F.lit(2.0), up)) == v for a, v in zip("xyz", (x, y, z))]
    return (up >= 0) & shifted[0] & shifted[1] & shifted[2]
