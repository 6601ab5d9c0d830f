import corpus_pipeline as P
from pyspark.sql import functions as F

from test_operators import SCHEMA, documents, prose


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = prose(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = spark.createDataFrame([(500, "so " + item + " end", "en", "s1", 9, 1, "c", 2, 3, "d", 4)], SCHEMA)
    docs = documents(spark).unionByName(extra)
    seen = []
    for i, (name, stage) in enumerate(P.STAGES):
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        before, docs = docs.columns, stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "shard":
            assert docs.columns == before
    near, clean, mixed = seen[1], seen[2], seen[3]
    assert 6 in near and not near & {7, 8, 9, 10} and 500 in near and 500 not in clean and clean == near - {500}
    assert mixed <= clean and seen[4] == mixed


def test_stages_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs.filter(F.lit(True)), str(tmp_path))
        assert docs.count() == 0
