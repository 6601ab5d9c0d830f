"""Item-sized windows of whole texts and what is shared by operators that look items up in them; DataFrame functions only.

Words are runs of letters and digits, lower-cased. A shingle is ``k`` consecutive
words, as a 64-bit hash; an item of fewer than ``k`` words is one shingle of all of them. An
item of ``m`` shingles is looked for in every window of ``m`` consecutive shingles (a text
of fewer is one window). Windows in which fewer shingles than the verification asks for occur
in any item at all are passed over: what counts is whether a shingle is in the set of all items'
shingles, not which item's it is, nor where it stands in it, so that no window that can pass is lost,
whatever the order of its words. Which item a window resembles is found by the operators' own fingerprints.

The scan uses ``posexplode_outer``: for the inner form the optimizer infers a
filter on the array's size and computes the whole array again for it, word by word.

Texts are known by a 64-bit hash (``th``), so copies are looked at once after the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, packed, spread


@dataclass(frozen=True)
class PassageParams:
    words: int = 5
    threshold: float = 0.8
    broadcast_bytes: int = 10 << 20  # of a table of hashes as stored, that may be broadcast; a larger one is joined by a shuffle


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def grams(w: str, k: int) -> Column:
    """Hashes of all runs of k words of an array column, in order."""
    last = F.size(w) - k
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(w), i + j) for j in range(k)]))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, key: str, text: str, scratch: Scratch, p: PassageParams) -> DataFrame:
    """(item, row, k, m, d, hs): shingle length, number, distinct number and hashes of every item that has words; equal keys are separate rows of one item."""
    w = items.select(F.col(f"`{key}`").alias("item"), words_of(F.col(f"`{text}`")).alias("w")).filter("item is not null and w[0] != ''")
    w = w.withColumn("k", F.least(F.size("w"), F.lit(p.words)))
    by_k = F.coalesce(*[F.when(F.col("k") == k, grams("w", k)) for k in range(1, p.words + 1)])
    w = w.withColumn("hs", by_k).select("item", F.xxhash64("item", "hs").alias("row"), "k", F.size("hs").alias("m"), F.size(F.array_distinct("hs")).alias("d"), "hs")
    return scratch.save(w.distinct())


def small(df: DataFrame, scratch: Scratch, p: PassageParams) -> DataFrame:
    """A written table, to be broadcast if its size allows it; a larger one is left to a shuffle."""
    out = scratch.save(df)
    return F.broadcast(out) if scratch.bytes(out) <= p.broadcast_bytes else out


def windows(docs: DataFrame, text: Column, items: DataFrame, need: Callable[[Column, Column, Column], Column], scratch: Scratch, p: PassageParams) -> DataFrame:
    """(th, k, m, start, hs): every window of an item's size with ``need(w, m, d)`` shingles that occur in items.

    ``w`` is the window's number of shingles, which is ``m`` but in a text of fewer;
    ``d`` is the least distinct number of the items of that size. Nothing is written here but the
    places of the texts' shingles that occur in items; windows are made as they are read.
    """
    spark = docs.sparkSession
    sizes = scratch.save(items.groupBy("k", "m").agg(F.min("d").alias("d")))
    by_k = sizes.groupBy("k").agg(F.min(need((F.col("m") * p.threshold).cast("int"), F.col("m"), F.col("d"))).alias("least")).orderBy("k").collect()  # at most p.words rows
    if not by_k:
        return spark.createDataFrame([], "th long, k int, m int, start int, hs array<bigint>")
    ks = [r["k"] for r in by_k]
    own = small(items.select("k", F.explode("hs").alias("h")).groupBy("h").agg(F.min("k").alias("k")), scratch, p)
    texts = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), words_of(text).alias("w"))
    every = texts.select("th", F.size("w").alias("n"), (F.concat(*[grams("w", k) for k in ks]) if len(ks) > 1 else grams("w", ks[0])).alias("hs"))
    seeds = every.select("th", "n", F.posexplode_outer("hs").alias("at", "h")).filter("h is not null").join(own, "h")
    before = F.lit(0)  # shingles of lesser lengths stand before those of length k
    for lesser in ks:
        before = before + F.when(F.col("k") > lesser, F.greatest(F.col("n") - lesser + 1, F.lit(0))).otherwise(0)
    places = seeds.select("th", "k", (F.col("at") - before).alias("pos")).groupBy("th", "k").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    least = F.coalesce(*[F.when(F.col("k") == r["k"], r["least"]) for r in by_k])
    places = scratch.save(places.filter(F.size("at") >= least))
    bodies = texts.select("th", "w").join(small(places.select("th"), scratch, p), "th", "left_semi").groupBy("th").agg(F.first("w").alias("w"))
    both = places.repartition(spread(spark), "th").join(bodies, "th")
    hs = F.coalesce(*[F.when(F.col("k") == k, grams("w", k)) for k in ks])
    rows = both.select("th", "k", "at", hs.alias("hs")).withColumn("n", F.size("hs")).join(F.broadcast(sizes) if scratch.bytes(sizes) <= p.broadcast_bytes else sizes, "k")
    rows = rows.withColumn("w", F.least("m", "n")).withColumn("need", need(F.col("w"), F.col("m"), F.col("d")).cast("int")).filter("size(at) >= need and w >= need and need > 0")
    # the i-th place is the first one in a window that begins after the place before it, and as many follow as are needed
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("at") - F.col("need"))))
    first, last = F.get("at", F.col("i")), F.get("at", F.col("i") + F.col("need") - 1)
    lo = F.greatest(F.coalesce(F.get("at", F.col("i") - 1) + 1, F.lit(0)), last - F.col("w") + 1, F.lit(0))
    rows = rows.withColumn("lo", lo).withColumn("hi", F.least(first, F.col("n") - F.col("w"))).filter("lo <= hi")
    rows = rows.withColumn("start", F.explode(F.sequence("lo", "hi")))
    return rows.select("th", "k", "m", "start", F.slice("hs", F.col("start") + 1, F.col("w")).alias("hs"))


def overlap(a: str, b: str) -> Column:
    """The sum over shingles of the lesser count in two array columns; a look at each pair of counts only where both repeat some."""
    held = F.array_intersect(a, b)
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    counted = F.aggregate(held, F.lit(0), lambda n, h: n + F.least(count(F.col(a), h), count(F.col(b), h)))
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(single, F.size(held)).otherwise(counted)


def per_document(docs: DataFrame, keep: list[str], results: list[str], text: Column, matches: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Kept columns of every row, packed, with the aggregates over its text's matches (null where there are none)."""
    found = matches.groupBy("th").agg(*aggregates)
    return packed(docs, keep, results, th=F.xxhash64(F.coalesce(text, F.lit("")))).join(found, "th", "left")
