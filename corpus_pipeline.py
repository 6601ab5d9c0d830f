"""The corpus pipeline: quality, near duplicates, decontamination, mixing and sharding of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
as Parquet in the shared folder before the next reads it. Rows are known by a
hash of all their columns where a stage has to find them again, so null or
repeated keys do no harm: equal rows are one document to stages 2 and 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapoint.llm.decontaminate import contaminated
from stratapoint.llm.jaccard import jaccard_join
from stratapoint.llm.mixing import mix_sources, word_count
from stratapoint.llm.quality import QualityParams, fit_quality, score_quality
from stratapoint.llm.scratch import Scratch, packed, unpacked
from stratapoint.llm.sharding import shard_rows

ORACLE_SQL = None  # fitted models and hashing: tests/llm/test_registered.py checks run() on a small fixture; mixing only per source, against the operator


def _row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rule ensemble scores at its threshold or above; empty texts are scored too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit_quality(docs, labels, "doc_id", "text", "quality", fold != 2)
    rows = packed(docs, docs.columns, [], text=F.col("text"))
    return unpacked(score_quality(rows, "text", model, "score").filter(F.col("score") >= QualityParams.threshold))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of linked documents, once; documents without words stay."""
    found = jaccard_join(docs, "doc_id", "text")
    kept = found.filter("kept").select(F.col("row_hash").alias("_hash")).distinct()
    rows = packed(docs, docs.columns, [], _hash=_row_hash(docs)).join(kept.hint("merge"), "_hash")
    first = F.row_number().over(W.partitionBy("_hash").orderBy(F.lit(1)))
    return unpacked(rows.withColumn("_n", first).filter("_n = 1"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = packed(docs, docs.columns, [], text=F.col("text"))
    return unpacked(contaminated(rows, ["_keep"], "text", items, "item_id", "text").filter("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as their source's target asks: a document is there once for each pass that takes more than half of its words."""
    keyed = packed(docs, docs.columns, [], row_hash=_row_hash(docs), text=F.col("text"), source=F.col("source"))
    taken = mix_sources(keyed, ["row_hash"], word_count(F.col("text")), F.col("source"))
    copies = taken.groupBy("row_hash").agg(F.round(F.avg("copies")).cast("int").alias("_copies")).filter("_copies > 0")
    rows = keyed.drop("text", "source").join(copies.hint("merge"), "row_hash")
    return unpacked(rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with size (bytes and one), shard (0 to 15) and slot; columns of these names give way."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    return shard_rows(docs, F.col("text"), ["doc_id"], size)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
