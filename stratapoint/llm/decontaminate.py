"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

64-bit fingerprints are cut into blocks; if two differ in at most ``blocks * (flips + 1) - 1``
bits, some block differs in at most ``flips``. The items' blocks are listed with
all flips, so that an equi-join on blocks finds every fingerprint within that radius.
What it finds is verified by the weighted Jaccard similarity of shingle counts.

The 64 sums of a fingerprint are kept in lanes of long numbers, several sums in one:
a lane's count can't run over into the next, and adding a constant sets a lane's
mark where more than half of the shingles have the bit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import PassageParams, item_shingles, overlap, per_document, small, windows
from .scratch import Scratch, unpacked

BITS = 64


@dataclass(frozen=True)
class SimHashParams(PassageParams):
    blocks: int = 8
    flips: int = 2

    @property
    def radius(self) -> int:
        return self.blocks * (self.flips + 1) - 1


def fingerprint(hs: str, lane: int) -> Column:
    """The SimHash of an array of shingle hashes, counted as often as they occur; ``lane`` bits hold a count below 2 ** (lane - 2)."""
    ones = sum(1 << b for b in range(0, BITS, lane))
    top = lane - 2
    add = ((1 << top) - 1) - F.floor(F.size(hs) / 2).cast("long")
    mark = F.lit(ones << top)

    def bits(j: int) -> Column:
        counts = F.aggregate(hs, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones)))
        marked = F.shiftright((counts + add * F.lit(ones)).bitwiseAND(mark), top)
        return F.shiftleft(marked, j)

    return reduce(Column.bitwiseOR, [bits(j) for j in range(lane)])


def lane_of(most: int) -> int:
    """Bits of a lane for windows of so many shingles at most."""
    return next(w for w in (8, 16, 32) if most < 1 << (w - 2))


def blocks_of(fp: str, p: SimHashParams, masks: list[int]) -> Column:
    width = BITS // p.blocks
    low = F.lit((1 << width) - 1)
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, b * width).bitwiseAND(low).bitwiseXOR(F.lit(m)).alias("value")) for b in range(p.blocks) for m in masks])


def contaminated(docs: DataFrame, keep: list[str], text: str, items: DataFrame, item_key: str, item_text: str, p: SimHashParams = SimHashParams()) -> DataFrame:
    """Kept columns, contaminated (boolean), n_items, items (sorted keys) and similarity (of the best window), one row per row of docs.

    A document is contaminated if one of its windows, of an item's number of
    shingles (all of its shingles if it has fewer), has a weighted Jaccard similarity of the threshold or more with the item. Null
    and empty texts are clean; items without a key or without words match
    nothing. Repeated rows get equal results. Kept columns named like
    a result give way to it.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    bench = item_shingles(items, item_key, item_text, scratch, p)
    lane = lane_of(bench.agg(F.max("m")).first()[0] or 0)
    share = p.threshold / (1 + p.threshold)  # of both sizes together, that must be shared at the threshold
    wins = windows(docs, F.col(f"`{text}`"), bench, lambda w, m, d: F.ceil((w + m) * share - 1e-9), scratch, p)
    key = ["th", "k", "m", "start"]
    width = BITS // p.blocks
    masks = [sum(1 << b for b in c) for n in range(p.flips + 1) for c in combinations(range(width), n)]
    asking = wins.withColumn("fp", fingerprint("hs", lane)).select(*key, "hs", "fp", F.explode(blocks_of("fp", p, [0])).alias("x")).select(*key, "hs", "fp", "x.block", "x.value")
    known = bench.select("row", "k", "m", fingerprint("hs", lane).alias("item_fp"))
    known = known.select("row", "k", "m", "item_fp", F.explode(blocks_of("item_fp", p, masks)).alias("x")).select("row", "k", "m", "item_fp", "x.block", "x.value")
    far = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near_block = [F.when(F.bit_count(F.shiftrightunsigned(far, b * width).bitwiseAND(F.lit((1 << width) - 1))) <= p.flips, b) for b in range(p.blocks)]
    near = asking.join(small(known, scratch, p), ["k", "m", "block", "value"]).filter((F.bit_count(far) <= p.radius) & (F.col("block") == F.coalesce(*near_block)))  # a pair counts in its first block
    items_hs = bench.select("row", "item", F.col("hs").alias("item_hs"), F.col("m").alias("item_m"))
    pairs = near.select("th", "row", "hs").join(small(items_hs, scratch, p), "row")
    pairs = pairs.withColumn("both", overlap("hs", "item_hs")).withColumn("sim", F.col("both") / (F.size("hs") + F.col("item_m") - F.col("both")))
    found = scratch.save(pairs.filter(F.col("sim") >= p.threshold - 1e-12).groupBy("th", "item").agg(F.max("sim").alias("sim")))
    out = per_document(docs, keep, ["contaminated", "n_items", "items", "similarity"], F.col(f"`{text}`"), found, [F.array_sort(F.collect_set("item")).alias("items"), F.max("sim").alias("similarity")])
    none = F.array().cast(out.schema["items"].dataType)
    return unpacked(out, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
