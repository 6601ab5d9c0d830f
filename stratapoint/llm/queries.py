"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import SimHashParams, contaminated
from .embeddings import near_vectors
from .jaccard import jaccard_join
from .licenses import scan_licenses
from .mixing import mix_sources, word_count
from .pii import KINDS, find_pii
from .quality import QualityParams, fit_quality, score_quality
from .sharding import shard_rows
from .toxicity import ToxicParams, fit_grammar, score_toxicity
from .wordpiece import PieceCounter, count_tokens

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mixed = mix_sources(docs, ["doc_id"], word_count(F.col("text")), F.col("source"))
    return mixed.withColumn("first_slot", F.coalesce("first_slot", F.lit(-1)).cast("long"))  # -1: not in the mix


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    starts = F.transform("starts", lambda x: F.concat_ws(":", x["start"].cast("string"), x["license"]))
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), F.array_join(starts, ",").alias("starts"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), ["doc_id"], "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def _fold(k: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    grammar = fit_grammar(docs, labels, "doc_id", "text", "toxic", _fold(5) != 0)
    out = score_toxicity(docs, ["doc_id"], "text", grammar)
    held = F.coalesce(_fold(5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ToxicParams.threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, "doc_id", "text", "quality", _fold(4) != 2)
    out = score_quality(docs.select("doc_id", "text"), "text", model, "score")
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QualityParams.threshold).cast("int").alias("predicted"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return jaccard_join(docs, "doc_id", "text").select("doc_id", "class_id", "class_size", "n_links", "component_id", "kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of the base spans, which the patterns fix; spans holds those that the method adds too."""
    found = find_pii(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    of = lambda k: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{k}:"))).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], "base_sha256", "spans")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), ["doc_id"], "text", PieceCounter.from_sentencepiece(VOCABULARY))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"))
    out = shard_rows(slim, F.col("text_md5"), ["doc_id"], F.col("n_bytes") + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix": op1_mix, "op2_near_vectors": op2_near_vectors, "op3_licenses": op3_licenses, "op4_toxicity": op4_toxicity, "op5_quality": op5_quality, "op6_decontaminate": op6_decontaminate, "op7_ngram_join": op7_ngram_join, "op8_pii": op8_pii, "op9_token_counts": op9_token_counts, "op10_shard": op10_shard}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose rows it can express; the others are tested against plain versions in tests/llm."""
    return {"op1_mix": oracles.mix_sql(), "op2_near_vectors": oracles.vectors_sql(), "op3_licenses": oracles.licenses_sql(), "op6_decontaminate": oracles.decontaminate_sql(SimHashParams()), "op7_ngram_join": oracles.jaccard_sql(), "op10_shard": oracles.shards_sql()}
