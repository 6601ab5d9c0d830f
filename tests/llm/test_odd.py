"""Names with dots, keys named like results, long texts through Spark, and the compiled quality column against the rules themselves."""

import numpy as np
from pyspark.sql import functions as F

from stratapoint.llm.decontaminate import contaminated
from stratapoint.llm.embeddings import near_vectors
from stratapoint.llm.jaccard import jaccard_join
from stratapoint.llm.licenses import scan_licenses
from stratapoint.llm.mixing import mix_sources, word_count
from stratapoint.llm.pii import find_pii
from stratapoint.llm.quality import QualityParams, RuleModel, fit_quality, fit_rules, holds, score_quality, statistics
from stratapoint.llm.sharding import shard_rows
from stratapoint.llm.toxicity import ToxicParams, fit_grammar, score_toxicity
from stratapoint.llm.wordpiece import PieceCounter, count_tokens
from test_operators import ITEM, prose


def test_names_with_dots_and_keys_named_like_results(spark):
    rows = [(i, prose(30 + i), f"s{i % 2}") for i in range(12)]
    rows += [(12, rows[0][1], "s0"), (13, None, None)]
    docs = spark.createDataFrame(rows, "`a.b` long, `t.x` string, `s.c` string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)], 1) for i in range(9)], "`a.b` long, `v.e` array<double>, `l.b` int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "`a.b` long, `y.z` int")
    assert mix_sources(docs, ["a.b"], word_count(F.col("`t.x`")), F.col("`s.c`")).count() == 14
    assert {r[0]: r["n_links"] for r in jaccard_join(docs, "a.b", "t.x").collect()} == {i: int(i in (0, 12)) for i in range(14)}
    assert all(r["n_links"] == 2 for r in near_vectors(vectors, "a.b", "v.e", "l.b").collect())
    model = fit_quality(docs, labels, "a.b", "t.x", "y.z", F.lit(True))
    assert score_quality(docs, "t.x", model, "score").count() == 14
    grammar = fit_grammar(docs, labels, "a.b", "t.x", "y.z", F.lit(True))
    assert score_toxicity(docs, ["a.b"], "t.x", grammar).columns == ["a.b", "score", "evidence"]
    assert find_pii(docs, ["a.b"], "t.x").count() == contaminated(docs, ["a.b"], "t.x", docs.filter("`a.b` = 3"), "a.b", "t.x").count() == 14
    assert scan_licenses(docs, ["a.b"], "t.x").count() == count_tokens(docs, ["a.b"], "t.x", PieceCounter.build({"a"}, {"b"})).count() == 14
    assert shard_rows(docs, F.col("`t.x`"), ["a.b"], F.lit(1)).count() == 14
    for name in ("row_hash", "kept"):
        out = jaccard_join(docs.withColumnRenamed("a.b", name), name, "t.x")
        assert out.columns.count(name) == 1 and {r[name] for r in out.collect()} == set(range(14))
    out = near_vectors(vectors.withColumnRenamed("a.b", "n_links"), "n_links", "v.e", "l.b")
    assert out.columns == ["n_links", "component_id", "kept"] and {r["n_links"] for r in out.collect()} == set(range(9))
    out = mix_sources(docs.withColumnRenamed("a.b", "size"), ["size"], word_count(F.col("`t.x`")), F.col("`s.c`"))
    assert out.columns == ["size", "source_size", "target", "taken", "copies", "first_slot"] and {r["size"] for r in out.collect()} == set(range(14))


def test_long_texts_and_clashing_columns_through_spark(spark):
    long = " ".join([prose(200), ITEM, "vermin", "Licensed under the Apache License, Version 2.0", "mail me at a.b@c.de now"] * 60)
    docs = spark.createDataFrame([(0, long, 1.0, "x"), (1, prose(20), 2.0, "y"), (2, "x" * 300_000, None, None)], "doc_id long, text string, score double, evidence string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, y int")
    grammar = fit_grammar(docs, labels, "doc_id", "text", "y", F.lit(True))
    grammar.insults, grammar.weights = {"vermin": 4.0}, np.ones(6)
    got = {r["doc_id"]: r for r in score_toxicity(docs, docs.columns, "text", grammar).collect()}
    assert got[0]["evidence"][0] == 240.0 and got[1]["evidence"] is None and got[0]["score"] > got[2]["score"]
    model = fit_quality(docs, labels, "doc_id", "text", "y", F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in score_quality(docs, "text", model, "score").collect())
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r["doc_id"]: (r["items"], r["similarity"]) for r in contaminated(docs, ["doc_id"], "text", items, "item_id", "text").collect()} == {0: ([7], 1.0), 1: ([], 0.0), 2: ([], 0.0)}
    got = {r["doc_id"]: r for r in scan_licenses(docs, ["doc_id"], "text").collect()}
    assert got[0]["licenses"] == ["Apache-2.0"] and len(got[0]["starts"]) >= 60 and not got[2]["licenses"]
    assert {r["doc_id"]: r["n_email"] for r in find_pii(docs, ["doc_id"], "text").collect()} == {0: 60, 1: 0, 2: 0}


def test_the_compiled_column_is_the_rules(spark):
    rng = np.random.default_rng(3)
    texts = [prose(int(n)) + " !!" * int(n % 7) + " 123" * int(n % 5) + "\n| a | b |" * int(n % 4) for n in rng.integers(0, 80, 150)] + ["", None, "\n\n", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = statistics(F.col("text"))
    x = np.array([list(r) for r in docs.orderBy("doc_id").select(*stats.values()).collect()], float)
    y = (x[:, 6] + x[:, 4] + rng.normal(size=len(x)) * 0.01 > 0.05).astype(float)
    fitted = fit_rules(x, y, QualityParams(trees=6, leaf=0.02))
    assert len(fitted.rules) > 3
    random_rules = RuleModel(0.3, [(float(rng.normal()), tuple((int(j), bool(rng.integers(2)), float(np.quantile(x[:, j], rng.random()))) for j in rng.choice(x.shape[1], 3, replace=False))) for _ in range(40)])
    for model in (fitted, random_rules):
        want = 1 / (1 + np.exp(-(model.intercept + sum(w * holds(x, rule) for w, rule in model.rules))))
        got = [r["s"] for r in score_quality(docs, "text", model, "s").orderBy("doc_id").collect()]
        assert np.allclose(got, want, atol=1e-12)


def test_near_copies_are_fitted_once_and_long_words_are_learned(spark):
    word = "v" + "e" * 60 + "rmin"
    rows = [prose(40) + f" {word} " + prose(20) for _ in range(20)] + [prose(60) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(80)], "doc_id long, toxic int")
    assert any(word.startswith(e.rstrip("*")) for e in fit_grammar(docs, labels, "doc_id", "text", "toxic", F.lit(True), ToxicParams()).insults)
