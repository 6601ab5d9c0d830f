"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the mix has the base-2 van der Corput point of ``i``; mapped through
the sources' cumulative targets it names a source, and its rank among that
source's slots names the next block of the source's shuffled stream. Blocks hold
the same number of words, so slot counts are word counts. Only DataFrame
functions are used; all windows run over hash buckets, never over a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import bucket_offsets, ranked
from .scratch import Scratch

SEPARATORS = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)  # repeating over the sources by code point, null last
    share: float = 1.5  # of all words, what the mix takes
    cap: int = 2  # a source gives at most so many times its words
    block_words: int = 1024
    bucket_rows: int = 1024  # rows that one window orders
    chunk_slots: int = 4096
    seed: int = 42


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SEPARATORS}]*[^{SEPARATORS}]+[{SEPARATORS}]*", "x")
    return F.length(F.regexp_replace(marks, f"[{SEPARATORS}]+", "")).cast("long")


def shuffle_key(seed: int, key: list[Column]) -> Column:
    """A number below 2**60 by which rows are shuffled: from the MD5 of the seed and the key, so that any SQL engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def van_der_corput(i: Column) -> Column:
    """The base-2 radical inverse of the low 32 bits of i, in [0, 1)."""
    v = i.bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        low = F.lit(mask)
        v = F.shiftright(v, shift).bitwiseAND(low).bitwiseOR(F.shiftleft(v.bitwiseAND(low), shift))
    return v.cast("double") / F.lit(float(2**32))


def source_targets(sizes: DataFrame, scratch: Scratch, p: MixParams) -> DataFrame:
    """sizes (source_key, source_size) with sid, weight, target and the target's interval.

    Water-filling: a level is raised until sum(min(cap * size, level * weight)) is
    the asked share. Each round is one aggregate, and only its one row is fetched.
    """
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), (F.col("sid") % len(p.weights) + 1).cast("int"))
    src = scratch.save(ranked(scratch.save(sizes), [F.col("source_key")], "sid", scratch).withColumn("weight", weight))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * F.lit(float(p.cap))
    goal, level, held = p.share * total, 0.0, -1
    while True:
        full = (most <= F.col("weight") * F.lit(level)) | (F.col("source_size") == 0)
        row = src.agg(F.sum(F.when(full, most).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("n")).first()
        if not row["open"] or row["n"] == held:
            break
        held, level = row["n"], max(level, (goal - row["used"]) / row["open"])
    src = src.withColumn("target", F.least(most, F.col("weight") * F.lit(level)) if row["open"] else most)
    src = src.withColumn("take", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * p.cap).cast("long"))
    return scratch.save(ranked(src, [F.col("sid")], "_r", scratch, {"take": "take_from"}).drop("_r"))


def schedule(sources: DataFrame, scratch: Scratch, p: MixParams) -> DataFrame:
    """(sid, block, slot, word_from, word_to): which blocks of each source's stream the mix takes, and when.

    A source that the low-discrepancy points leave a block or two short gets its
    last blocks after the other slots; slots beyond its target are passed over.
    The last block ends at the target, so every source gives its target to the word.
    """
    spark = sources.sparkSession
    row = sources.agg(F.sum("take").alias("all"), F.count(F.lit(1)).alias("n")).first()
    total, b = row["all"] or 0, p.block_words
    n_slots, grid = -(-total // b), max(1024, row["n"])
    lo, hi = F.col("take_from") / F.lit(float(max(total, 1))), (F.col("take_from") + F.col("take")) / F.lit(float(max(total, 1)))
    # each source's interval is cut at a grid, so that points find it by an equi-join
    pieces = (
        sources.filter("take > 0").select("sid", "take", lo.alias("lo"), hi.alias("hi"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid).cast("long"), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1)).cast("long"))))
    )
    point = van_der_corput(F.col("slot"))
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * grid).cast("long"))
    placed = slots.join(pieces, "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    placed = scratch.save(placed.select("sid", "take", "slot", F.floor(F.col("slot") / p.chunk_slots).cast("long").alias("chunk")))
    per = placed.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = bucket_offsets(per, ["sid"], "chunk", {"n": "n0"}, -(-n_slots // p.chunk_slots))
    rank = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1 + F.col("n0")
    taken = placed.join(before, ["sid", "chunk"]).select("sid", "take", "slot", rank.cast("long").alias("block"))
    blocks = F.ceil(F.col("take") / b).cast("long")
    short = (
        sources.join(placed.groupBy("sid").agg(F.count(F.lit(1)).alias("had")), "sid", "left")
        .select("sid", "take", F.coalesce("had", F.lit(0)).cast("long").alias("had"), blocks.alias("need")).filter("had < need")
        .select("sid", "take", F.lit(n_slots).cast("long").alias("slot"), F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("block"))
    )
    out = taken.filter(F.col("block") < blocks).unionByName(short)
    return out.select("sid", "block", "slot", (F.col("block") * b).alias("word_from"), F.least((F.col("block") + 1) * b, F.col("take")).alias("word_to"))


def mix_sources(docs: DataFrame, key: list[str], size: Column, source: Column, p: MixParams = MixParams()) -> DataFrame:
    """One row per row of docs: key columns, size, source_size, target, taken, copies, first_slot.

    ``taken`` is the number of the row's words in the mix, repeats counted (0 to
    cap times size); ``copies`` is how often more than half of its words are taken in one pass
    over its source. Nulls: a null source is a source of its own, a null text has
    size 0. Rows of size 0 take no part and have taken 0. Repeated rows are
    separate rows. No documents: no rows. A result with the name of a key column is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    named = {c: f"_key{i}" for i, c in enumerate(key)}
    source_key = F.coalesce(F.concat(F.lit("="), source), F.lit("~"))
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], size.alias("size"), source_key.alias("source_key"))
    slim = scratch.save(slim.withColumn("_hash", shuffle_key(p.seed, [F.col(n) for n in named.values()])))
    sizes = slim.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, scratch, p)
    n = max(1, -(-slim.count() // p.bucket_rows))
    rows = slim.join(sources.select("source_key", "sid", "source_size", "target", "take"), "source_key").drop("source_key")
    rows = rows.withColumn("bucket", F.pmod("_hash", F.lit(n)))
    before = bucket_offsets(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("s")), ["sid"], "bucket", {"s": "_from"}, n)
    w = W.partitionBy("sid", "bucket").orderBy("_hash", *named.values(), "size")
    rows = rows.join(before, ["sid", "bucket"]).withColumn("_row", F.row_number().over(w))
    rows = scratch.save(rows.withColumn("_from", F.col("_from") + F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")))
    b = p.block_words
    # the stream of a source is its rows, then its rows again: a pass that begins beyond the target takes nothing
    starts = F.transform(F.sequence(F.lit(0), F.lit(p.cap - 1)), lambda k: F.struct(k.alias("pass"), (F.col("_from") + k * F.col("source_size")).alias("lo")))
    starts = F.when(F.col("size") > 0, F.filter(starts, lambda x: x["lo"] < F.col("take"))).otherwise(F.array().cast("array<struct<pass:int,lo:bigint>>"))
    spans = F.flatten(F.transform(starts, lambda x: F.transform(
        F.sequence(F.floor(x["lo"] / b).cast("long"), F.floor((x["lo"] + F.col("size") - 1) / b).cast("long")),
        lambda k: F.struct(x["pass"].alias("pass"), x["lo"].alias("lo"), k.alias("block")))))
    keep = ["sid", "bucket", "_row", *named.values(), "size", "source_size", "target"]
    pieces = rows.select(*keep, F.explode_outer(spans).alias("p")).select(*keep, "p.pass", "p.lo", "p.block")
    hit = pieces.join(scratch.save(schedule(sources, scratch, p)), ["sid", "block"], "left")
    words = F.greatest(F.lit(0), F.least(F.col("lo") + F.col("size"), F.col("word_to")) - F.greatest("lo", "word_from"))
    hit = hit.withColumn("_w", F.when(F.col("slot").isNull(), F.lit(0)).otherwise(words))
    passes = [F.sum(F.when(F.col("pass") == k, F.col("_w")).otherwise(0)).alias(f"_p{k}") for k in range(p.cap)]
    out = hit.groupBy(*keep).agg(F.sum("_w").cast("long").alias("taken"), F.min(F.when(F.col("_w") > 0, F.col("slot"))).alias("first_slot"), *passes)
    copies = sum(((F.col(f"_p{k}") * 2 > F.col("size")).cast("int") for k in range(p.cap)), F.lit(0))
    results = {c: F.col(c) for c in ("size", "source_size", "target", "taken")} | {"copies": copies.cast("int"), "first_slot": F.col("first_slot")}
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], *[c.alias(n) for n, c in results.items() if n not in named])
