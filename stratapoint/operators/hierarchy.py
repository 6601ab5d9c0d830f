"""The node index: building it, laying out chunks, planning pages and coalescing reads."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Entry, VoxelKey
from .lod import KEY
from .prefix import ranked
from .scratch import Scratch

PAGE_ENTRIES = 4096  # fixed value: entries of one index page
GAP = 64 * 1024  # fixed value: bytes between chunks that one read may span


def nodes_of(assigned: DataFrame, record_bytes: int, start: int = 0) -> DataFrame:
    """One row per node, in key order: point_count, byte_size and offset of its chunk.

    The running offset is over nodes, not points, and no window holds all nodes of a large cloud.
    """
    scratch = Scratch(assigned.sparkSession, "nodes")
    n = assigned.groupBy(*KEY).agg(F.count(F.lit(1)).alias("point_count"))
    n = scratch.save(n.withColumn("byte_size", F.col("point_count") * record_bytes))
    placed = ranked(n, [F.col(c) for c in KEY], "_rank", scratch, {"byte_size": "_before"})
    return placed.select(*KEY, (F.lit(start) + F.col("_before")).alias("offset"), "byte_size", "point_count")


def latest_entries(entries: DataFrame, seq: str) -> DataFrame:
    """Of several rows of a key the one loaded last stays; a node's own entry so replaces its pointer."""
    return entries.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in entries.columns if c not in (*KEY, seq)]), seq).alias("e")).select(*KEY, "e.*")


def total_points(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.agg(F.sum(F.when(F.col("point_count") > 0, F.col("point_count")).otherwise(0)).alias("points"), F.count(F.when(F.col("point_count") > 0, 1)).alias("nodes"))


def coalesce_ranges(chunks: DataFrame, gap: int = GAP) -> DataFrame:
    """Chunks with ``grp``: those at most gap bytes apart are fetched by one read."""
    scratch = Scratch(chunks.sparkSession, "ranges")
    order = [F.col("offset"), *(F.col(c) for c in KEY)]
    ends = scratch.save(chunks.withColumn("_end", F.col("offset") + F.col("byte_size")))
    seen = ranked(ends, order, "_rank", scratch, maxima={"_end": "_before"})
    fresh = (F.col("_before").isNull() | (F.col("offset") > F.col("_before") + gap)).cast("long")
    marked = scratch.save(seen.select(*chunks.columns, fresh.alias("_new")))
    return ranked(marked, order, "_rank", scratch, {"_new": "_groups"}).select(*chunks.columns, (F.col("_groups") + F.col("_new")).alias("grp"))


def first_of_nodes(assigned: DataFrame, n: int) -> DataFrame:
    """The first n points of every node; the pushed-down group limit keeps n of each before the shuffle."""
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("pos"))
    return assigned.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def plan_pages(entries: list[Entry], limit: int = PAGE_ENTRIES) -> list[tuple[VoxelKey, list[Entry], list[VoxelKey]]]:
    """(page root, own entries, roots of pages below), parents first.

    A set of entries that fits makes one page; else the page holds the root's own entry
    and a pointer for each octant with nodes. A work list, so depth is no concern.
    """
    out, todo = [], deque([(VoxelKey.root(), sorted(entries, key=lambda e: e.key))])
    while todo:
        root, own = todo.popleft()
        if len(own) <= limit:
            out.append((root, own, []))
            continue
        first = [e for e in own if e.key == root]
        below: dict[VoxelKey, list[Entry]] = {root.child(o): [] for o in range(8)}
        for e in own:
            if e.key != root:
                up = e.key.level - root.level - 1
                below[VoxelKey(root.level + 1, e.key.x >> up, e.key.y >> up, e.key.z >> up)].append(e)
        parts = [(k, es) for k, es in below.items() if es]
        out.append((root, first, [k for k, _ in parts]))
        todo.extend(parts)
    return out


def page_roots(hierarchy: DataFrame, limit: int = PAGE_ENTRIES, deepest: int = 30) -> DataFrame:
    """hierarchy with page_level, page_x, page_y, page_z: the page each entry is on, by the rule of ``plan_pages``.

    Subtree sizes of all ancestors decide it: an entry is on the page of its
    highest ancestor whose subtree fits, or on its own page if none does.
    """
    up = hierarchy.select(*KEY, F.explode(F.sequence(F.lit(0), F.col("level"))).alias("pl"))
    for a in "xyz":
        up = up.withColumn(f"p{a}", F.floor(F.col(f"k{a}") / F.pow(F.lit(2.0), F.col("level") - F.col("pl"))).cast("int"))
    size = up.groupBy("pl", "px", "py", "pz").agg(F.count(F.lit(1)).alias("n"))
    fit = up.join(size, ["pl", "px", "py", "pz"]).filter(F.col("n") <= limit)
    best = fit.groupBy(*KEY).agg(F.min_by(F.struct("pl", "px", "py", "pz"), "pl").alias("p"))
    own = F.struct(F.col("level").alias("pl"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("kz").alias("pz"))
    out = hierarchy.join(best, KEY, "left").withColumn("p", F.coalesce("p", own))
    return out.select(*hierarchy.columns, F.col("p.pl").alias("page_level"), F.col("p.px").alias("page_x"), F.col("p.py").alias("page_y"), F.col("p.pz").alias("page_z"))
