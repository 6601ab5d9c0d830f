"""Octree and level-of-detail assignment.

Per level, a node with more points than its capacity keeps as many, taken in turn from its
octants by lowest ordinal, and hands the others down. The turn order needs no
sort of the node: a point's place follows from its rank in its octant and from
the octants' counts. Ranks are counts of ordinal chunks plus a rank inside one
chunk, so that no task sees a whole node, not even the root or one of many equal points.
Every point is written once a level; counts are broadcast up to a checked number of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import MAX_LEVEL, Bounds, InvalidInput
from .prefix import bucket_offsets, ranked
from .scratch import Scratch

KEY = ["level", "kx", "ky", "kz"]
BROADCAST_NODES = 100_000  # rows of counts that may be broadcast
SPARSE = 16  # ordinals this many times as many as points are ranked first


def octant_of(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column) -> Column:
    return (x >= cx).cast("int") + (y >= cy).cast("int") * 2 + (z >= cz).cast("int") * 4


def turn(rank: Column, octant: Column, counts: list[Column]) -> Column:
    """1-based place of the octant's rank-th point when octants take turns."""
    before = [F.least(c, rank - 1) for c in counts]
    same = [((F.lit(o) < octant) & (c >= rank)).cast("long") for o, c in enumerate(counts)]
    return reduce(lambda a, b: a + b, before + same) + 1


def assign_lod(points: DataFrame, bounds: Bounds, capacity: int, ordinal: str = "idx", chunk: int = 8192) -> DataFrame:
    """points with level, kx, ky, kz (int) and pos (long, place in the node).

    ``ordinal`` must be distinct and not negative. Boxes come from repeated halving.
    """
    bounds.check()
    scratch = Scratch(points.sparkSession, "lod")
    capacity = max(1, capacity)
    center, half = bounds.root_cube()
    cube = Bounds.cube(center, half)
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(ordinal).alias("top")).first()
    if not size["n"]:
        raise InvalidInput("cannot write empty cloud")
    if size["top"] >= SPARSE * size["n"] + chunk:  # chunks of sparse ordinals would hold a point or two
        todo, chunks = ranked(points, [F.col(ordinal)], "_i", scratch), -(-size["n"] // chunk)
    else:
        todo, chunks = points.withColumn("_i", F.col(ordinal).cast("long")), size["top"] // chunk + 1
    todo = todo.withColumns({"kx": F.lit(0), "ky": F.lit(0), "kz": F.lit(0)})
    todo = scratch.save(todo.withColumns({f"_{a}{s}": F.lit(v) for s, corner in (("lo", cube.min), ("hi", cube.max)) for a, v in zip("xyz", corner)}))
    done, node = [], ["kx", "ky", "kz"]
    for level in range(MAX_LEVEL + 1):
        mids = [(F.col(f"_{a}lo") + F.col(f"_{a}hi")) * 0.5 for a in "xyz"]
        rows = todo.withColumn("_o", octant_of(*(F.col(a) for a in "xyz"), *mids)).withColumn("_c", F.floor(F.col("_i") / chunk).cast("long"))
        per = scratch.save(rows.groupBy(*node, "_o", "_c").agg(F.count(F.lit(1)).alias("_n")))
        counts = per.groupBy(*node).agg(*[F.coalesce(F.sum(F.when(F.col("_o") == o, F.col("_n"))), F.lit(0)).alias(f"_n{o}") for o in range(8)])
        counts = scratch.save(counts.withColumn("_all", sum((F.col(f"_n{o}") for o in range(8)), F.lit(0))))
        seen = counts.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("_all") > capacity, 1)).alias("full")).first()
        known = F.broadcast(counts) if seen["nodes"] <= BROADCAST_NODES else counts
        if seen["full"] < seen["nodes"]:
            leaves = rows.join(known.filter(F.col("_all") <= capacity).select(*node), node)
            place = F.row_number().over(W.partitionBy(*node).orderBy("_i")) - 1
            done.append(scratch.save(leaves.select(*points.columns, F.lit(level).alias("level"), *node, place.cast("long").alias("pos"))))
        if not seen["full"]:
            break
        full = known.filter(F.col("_all") > capacity)
        if level >= MAX_LEVEL:  # the deepest nodes keep all, ranked by chunks
            each = per.groupBy(*node, "_c").agg(F.sum("_n").alias("_n"))
            before = bucket_offsets(each, node, "_c", {"_n": "_b"}, chunks)
            place = F.row_number().over(W.partitionBy(*node, "_c").orderBy("_i")) - 1 + F.col("_b")
            rest = rows.join(full.select(*node), node).join(before, [*node, "_c"])
            done.append(scratch.save(rest.select(*points.columns, F.lit(level).alias("level"), *node, place.cast("long").alias("pos"))))
            break
        before = bucket_offsets(per, [*node, "_o"], "_c", {"_n": "_b"}, chunks)
        big = rows.join(full, node).join(before, [*node, "_o", "_c"])
        # only chunks that can still be in turn are ranked
        rank = F.row_number().over(W.partitionBy(*node, "_o", "_c").orderBy("_i")) + F.col("_b")
        turns = turn(F.col("_r"), F.col("_o"), [F.col(f"_n{o}") for o in range(8)])
        early = big.filter(F.col("_b") < capacity).withColumn("_r", rank).withColumn("pos", (turns - 1).cast("long"))
        late = big.filter(F.col("_b") >= capacity).withColumn("_r", F.lit(None).cast("long")).withColumn("pos", F.lit(None).cast("long"))
        placed = scratch.save(early.unionByName(late).select(*todo.columns, "_o", "pos"))
        kept = F.coalesce(F.col("pos") < capacity, F.lit(False))
        done.append(placed.filter(kept).select(*points.columns, F.lit(level).alias("level"), *node, "pos"))
        upper = {a: F.shiftright("_o", i).bitwiseAND(F.lit(1)) for i, a in enumerate("xyz")}
        step = {f"k{a}": F.col(f"k{a}") * 2 + upper[a] for a in "xyz"}
        step |= {f"_{a}lo": F.when(upper[a] == 1, m).otherwise(F.col(f"_{a}lo")) for a, m in zip("xyz", mids)}
        step |= {f"_{a}hi": F.when(upper[a] == 1, F.col(f"_{a}hi")).otherwise(m) for a, m in zip("xyz", mids)}
        todo, last = placed.filter(~kept).withColumns(step).select(*todo.columns), todo
        scratch.drop(last)  # its points are in placed or in the leaves; a table that is read again has no path of its own
        scratch.drop(per)
    return reduce(DataFrame.unionByName, done)
