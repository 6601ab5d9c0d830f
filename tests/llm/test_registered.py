"""Every registered query and the pipeline's run() on a small written fixture, against plain versions."""

import collections
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint.llm import queries as Q
from stratapoint.llm.licenses import scan_licenses
from stratapoint.llm.pii import base_spans, joined
from test_operators import ITEM, SCHEMA, plain_links, prose, words
from test_units import plain_pieces


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Texts with the word list's letters are good; those full of marks are bad and labelled so."""
    at = str(tmp_path_factory.mktemp("registered"))
    good = [prose(60) for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(30).split()) + " vermin" for _ in range(75)]
    near = good[0].split()
    more = [good[0], " ".join(["changed", *near[1:]]), "so " + prose(30) + " " + ITEM + " " + prose(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 7, "x", i, 3, "x", 9) for i, t in enumerate(good + bad + more)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(not 150 <= i < 225), int(150 <= i < 225)) for i in range(228)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    x = np.random.default_rng(1).normal(size=(20, 64))
    vectors = [(i, [float(v) for v in x[i % 20] * (1 + i)], i % 2) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, [(r[0], r[1], r[3]) for r in rows]


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_registered_queries(spark, fixture):
    at, rows = fixture
    got = {n: {r[0]: r.asDict() for r in q(spark, at).collect()} for n, q in Q.queries().items()}
    ids = {i for i, _, _ in rows}
    assert all(set(v) == (set(range(40)) if n == "op2_near_vectors" else ids) for n, v in got.items())
    assert all(r["n_links"] == 1 and r["component_id"] == i % 20 for i, r in got["op2_near_vectors"].items())
    plain = {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.read.parquet(f"{at}/documents.parquet"), ["doc_id"], "text").collect()}
    links = plain_links([t for _, t, _ in rows])
    model = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=Q.VOCABULARY)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    slots = collections.defaultdict(list)
    for i, t, _ in rows:
        bad = 150 <= i < 225
        assert got["op1_mix"][i]["size"] == len(words(t)) and got["op3_licenses"][i]["licenses"] == ",".join(plain[i])
        assert got["op4_toxicity"][i]["held_out"] == (fold(i, 5) == 0) and got["op4_toxicity"][i]["predicted"] == bad
        assert got["op5_quality"][i]["held_out"] == (fold(i, 4) == 2) and got["op5_quality"][i]["predicted"] == (not bad)
        assert got["op6_decontaminate"][i]["contaminated"] == (i == 227)
        r = got["op7_ngram_join"][i]
        assert (r["n_links"], r["kept"]) == (len(links[i]), i not in (225, 226)) and r["component_id"] == (0 if i in (225, 226) else i)
        assert got["op8_pii"][i]["spans"] == joined(base_spans(t))
        assert got["op9_token_counts"][i]["n_tokens"] == sum(plain_pieces(w, pieces, True) for w in t.split())
        r = got["op10_shard"][i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pipeline_run(spark, fixture):
    at, rows = fixture
    got = [(r["doc_id"], r["shard"], r["slot"], r["size"], r["text"]) for r in P.run(spark, at).collect()]
    clean = [(i, t, s) for i, t, s in rows if not 150 <= i < 225 and i not in (225, 226, 227)]  # bad, copies, contaminated
    table = spark.createDataFrame(clean, "doc_id long, text string, source string")
    copies = {r["doc_id"]: round(r["copies"]) for r in P.mix_sources(table, ["doc_id"], P.word_count(F.col("text")), F.col("source")).collect()}
    out = collections.Counter(i for i, *_ in got)
    assert set(out) <= {i for i, _, _ in clean} and max(out.values()) <= 2
    source = {i: s for i, _, s in clean}
    per = lambda c: collections.Counter({s: sum(n for i, n in c.items() if source[i] == s) for s in set(source.values())})
    assert all(abs(per(out)[s] - per(copies)[s]) <= 2 for s in set(source.values()))
    slots, size = collections.defaultdict(list), collections.Counter()
    for _, shard, slot, n, text in got:
        assert n == len(text.encode()) + 1 and 0 <= shard < 16
        slots[shard].append(slot)
        size[shard] += n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
