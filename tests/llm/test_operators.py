"""Each operator on small tables with nulls, ties, repeated rows, empty and long texts, and clashing column names; and on empty tables."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratapoint.llm import queries as Q
from stratapoint.llm.components import components
from stratapoint.llm.decontaminate import contaminated
from stratapoint.llm.embeddings import VectorParams, near_vectors
from stratapoint.llm.jaccard import JaccardParams, jaccard_join
from stratapoint.llm.licenses import scan_licenses
from stratapoint.llm.mixing import MixParams, mix_sources, van_der_corput, word_count
from stratapoint.llm.pii import PiiParams, base_spans, find_pii, joined
from stratapoint.llm.quality import fit_quality, score_quality
from stratapoint.llm.scratch import Scratch
from stratapoint.llm.sharding import ShardParams, shard_rows
from stratapoint.llm.shingles import shingled
from stratapoint.llm.toxicity import fit_grammar, score_toxicity
from stratapoint.llm.wordpiece import PieceCounter, count_tokens

RNG = np.random.default_rng(8)
WORDS = ["".join(RNG.choice(list("abcdeilnorst"), RNG.integers(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, items string, th long, shard int, spans string, k1 long"


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


BASE, ITEM = prose(60), prose(24)
WIDE = [prose(5000), None, "", " \n\t ", "one", "two words", BASE, BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " tail", prose(40) + " " + ITEM + " " + prose(30), ITEM.upper() + "!!", prose(80), prose(80), "mail me at a.b@c.de or 10.0.0.1 now", "Licensed under the Apache License, Version 2.0.", "x\n|a|b|\n" * 50]


def documents(spark, texts=WIDE):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), 7, "clash", i, 3, "clash", 9) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no key " + prose(9), None, None, None, None, None, None, None, None, None)] if texts else []
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(8).select(van_der_corput(F.col("id"))).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_mixing(spark):
    docs = documents(spark)
    p = MixParams(block_words=16, bucket_rows=4)
    run = lambda: mix_sources(docs, ["doc_id", "text"], word_count(F.col("text")), F.col("source"), p).withColumn("size", F.col("size")).collect()
    got = run()
    assert sorted(map(repr, got)) == sorted(map(repr, run()))
    assert len(got) == docs.count()
    size, source = collections.Counter(), {}
    for r in docs.select("doc_id", "text", "source").collect():
        size[r.source] += len(words(r.text))
    order = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    by_size = collections.defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        by_size[round(r["target"], 6)] += r["taken"]
    assert {round(t, 6) for t in target.values()} == set(by_size)
    assert sum(by_size.values()) == pytest.approx(sum(target.values()), abs=len(target))


@pytest.mark.parametrize("texts", [WIDE, WIDE[:1] + ["same text"] * 200])
def test_sharding(spark, texts):
    docs = documents(spark, texts)
    p = ShardParams(shards=4, bucket_rows=8)
    got = shard_rows(docs, F.col("text"), ["doc_id"], F.octet_length(F.coalesce("text", F.lit(""))) + 1, p).collect()
    assert len(got) == docs.count()
    slots, bytes_ = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        assert r["size"] == len((r["text"] or "").encode()) + 1 and 0 <= r["shard"] < 4
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in got)
    assert all(abs(bytes_[s] - sum(bytes_.values()) / 4) <= largest + 1 for s in range(4))


def test_shards_do_not_depend_on_how_rows_are_dealt(spark):
    docs = documents(spark)
    p = ShardParams(shards=4, bucket_rows=8)
    runs = [shard_rows(docs.repartition(n), F.col("text"), ["doc_id"], F.octet_length(F.coalesce("text", F.lit(""))) + 1, p) for n in (1, 5)]
    assert len({repr(sorted(map(repr, r.select("doc_id", "size", "shard", "slot").collect()))) for r in runs}) == 1


def plain_links(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]


def test_jaccard_join(spark):
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(BASE.split())) for k in range(0, 60, 2)]
    docs = documents(spark, WIDE + near)
    rows = docs.collect()
    links = plain_links([r["text"] for r in rows])
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in links[i])], key=lambda g: (rows[g]["doc_id"] is None, rows[g]["doc_id"])) for i in range(len(rows))]
    want = sorted((repr(r["doc_id"]), len(links[i]), repr(rows[group[i]]["doc_id"])) for i, r in enumerate(rows))
    for p in (JaccardParams(), JaccardParams(block=4, node_rows=8, leaders=3)):
        got = jaccard_join(docs, "doc_id", "text", p).collect()
        assert sorted((repr(r["doc_id"]), r["n_links"], repr(r["component_id"])) for r in got) == want
        assert all(r["kept"] for r in got if r["doc_id"] == r["component_id"])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 260)]}
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))]
    group = list(range(300))
    for _ in range(300):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: group[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 10] * 3 + rng.normal(size=8) * 0.1], int(i % 2)) for i in range(60)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 0), (205, [None] * 8, 0), (206, [float("inf")] + [0.0] * 7, 0), (207, [], 0), (208, rows[0][1][:4], 0), rows[3], rows[3]]
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.98] for i in range(len(rows))]
    comp = [r[0] for r in rows]
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(len(rows))]
    want = sorted((r[0], len(links[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for p in (VectorParams(), VectorParams(cell_rows=2, chunk=3)):
        assert sorted(map(tuple, near_vectors(df, "vec_id", "embedding", "label", p).collect())) == want


@pytest.mark.parametrize("d, cell_rows", [(64, 4), (64, 25), (256, 4), (768, 25)])
def test_near_vectors_of_many_dimensions_and_codes(spark, d, cell_rows):
    rng = np.random.default_rng(d)
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    ends = [np.cos(t) * a + np.sin(t) * b for t in (0.0, 0.19)]  # every pair is linked, and codes part the ends
    x = np.array([ends[i % 2] + rng.normal(size=d) * 1e-4 for i in range(100)] + [ends[0] + rng.normal(size=d) * 0.14 / np.sqrt(d) for _ in range(100)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, "vec_id", "embedding", "label", VectorParams(cell_rows=cell_rows)).collect()}
    assert [got[i] for i in range(len(x))] == links.tolist() and links.min() < links.max()


def test_decontamination(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "never there " + prose(9)), (None, ITEM), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    got = {r["doc_id"]: r for r in contaminated(documents(spark), ["doc_id", "items", "th"], "text", items, "item_id", "text").collect()}
    assert got[11]["items"] == [1] and got[12]["items"] == [1] and got[5]["items"] == [5] and got[11]["similarity"] == 1.0
    assert not any(got[i]["contaminated"] for i in (0, 1, 2, 3, 4, 6, 13, 14))


def test_decontamination_of_edited_passages(spark):
    item = prose(50).split()
    edits = {0: item, 1: [*item[:20], "new", *item[20:]], 2: ["other", *item[1:]], 3: item[:30], 4: [w if i % 5 else "gone" for i, w in enumerate(item)]}
    docs = spark.createDataFrame([(k, prose(30) + " " + " ".join(v) + " " + prose(30)) for k, v in edits.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in contaminated(docs, ["doc_id"], "text", spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), "item_id", "text").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_licenses(spark):
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(documents(spark), ["doc_id"], "text").collect()}
    assert got[16] == ["Apache-2.0"] and not got[0] and not got[1] and not got[2]


def test_pii(spark):
    cues = [(1000 + i, f"{prose(3)} passport: 12-{i:04d}-777 {prose(2)} call hotline +1 (555) 010-{i:04d} ok") for i in range(30)]
    docs = documents(spark).select("doc_id", "text", "spans").unionByName(spark.createDataFrame([(*c, "x") for c in [*cues, (2000, prose(3) + " call hotline 555 0199 1234 x hotline 5550199123 ok")]], "doc_id long, text string, spans string"))
    got = find_pii(docs, ["doc_id", "text", "spans"], "text", PiiParams(support=5)).collect()
    assert len(got) == docs.count()
    for r in got:
        base = joined(base_spans(r["text"] or ""))
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
        assert set(filter(None, base.split(","))) <= set(filter(None, r["spans"].split(",")))
        for k in ("email", "ip", "card", "phone"):
            assert r[f"n_{k}"] == r["spans"].count(k)
    assert next(r for r in got if r["doc_id"] == 2000)["n_phone"] == 2  # found by their context alone, the one written in groups too


def test_pii_of_runs_edges_and_rounds(spark):
    texts = [f"{prose(3)} hotline +1 (555) 010-{i:04d} ok" for i in range(80)]
    found = {
        "dial hotline 555 0199 1234 x": ["555 0199 1234"],
        "dial hotline (555) 0199-1235, x": ["(555) 0199-1235"],
        "dial hotline 555 - 0199 - 1236 x": ["555 - 0199 - 1236"],
        "dial hotline 5550199123 x hotline 555 0199 77": ["5550199123", "555 0199 77"],
        "dial hotline 555 0199 1237 2024-01-05 17 x": ["555 0199 1237"],  # the whole run has too many digits
        "dial hotline 5550199124" + "]" * 70 + " x": ["5550199124"],
    }
    texts += found
    # each step names the next: hotline, then alpha, beta and gamma by numbers known from the step before
    chain = ["hotline", "alpha", "beta", "gamma", "delta"]
    for k, (cue, after) in enumerate(zip(chain, chain[1:])):
        for i in range(9):
            texts += [f"say {cue} 77{k}0000{i} w{k}q{i}", f"say {after} 77{k}0000{i} v{k}q{i}"]
    texts += ["say delta 9876543 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: r["spans"] for r in find_pii(docs, ["text"], "text", PiiParams(support=5, confidence=0.4)).collect()}
    surfaces = lambda t: [t[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[t].split(",") if x)]
    for text, want in found.items():
        assert len(surfaces(text)) == len(want) and all(a.startswith(b) for a, b in zip(surfaces(text), want)), (text, surfaces(text))
    for text in list(found)[:4]:
        assert surfaces(text) == found[text]
    assert surfaces("say delta 9876543 end") == ["9876543"]  # takes five rounds


def test_token_counts(spark):
    counter = PieceCounter.build({"o", "two"}, {"n", "e"})
    got = {r["doc_id"]: tuple(r)[1:] for r in count_tokens(documents(spark), ["doc_id"], "text", counter).collect()}
    assert got[1] == got[2] == got[3] == (0, 0, 0) and got[4] == (1, 0, 3) and got[5] == (2, 1, 2)


def test_classifiers(spark):
    texts = [prose(60) if i % 3 else prose(20) + f" foul{'abc'[i % 3]}{'xyz'[i // 3 % 3]} " + " ".join(w + "###" for w in prose(30).split()) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels, "doc_id", "text", "quality", F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["s"] for r in score_quality(docs, "text", model, "s").collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in range(2, 300, 4)]) > 0.95 and all(0 <= v <= 1 for v in got.values())
    grammar = fit_grammar(docs, labels, "doc_id", "text", "toxic", F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, ["doc_id"], "text", grammar).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(0, 300, 5)]) > 0.95 and all(0 <= v <= 1 for v in got.values())


def test_texts_that_share_a_passage_are_fitted_apart(spark):
    passage = min((prose(60) for _ in range(300)), key=lambda t: shingled(pa.array([t])).values.min())  # holds the least shingle of all that share it
    rows = [f"{passage} {prose(20)} {w} {prose(20)}" for w in ["vermin"] * 12 + ["scumbag"] * 12] + [prose(100) for _ in range(60)]
    copied = prose(100).split()
    rows += [" ".join([*copied[:k], "swine", *copied[k + 1 :]]) for k in range(40, 42)] * 6  # two near copies, each six times
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 24 or i >= 84)) for i in range(len(rows))], "doc_id long, toxic int")
    insults = fit_grammar(docs, labels, "doc_id", "text", "toxic", F.lit(True)).insults
    assert {w for w in ("vermin", "scumbag") if any(w.startswith(e.rstrip("*")) for e in insults)} == {"vermin", "scumbag"}
    assert not any("swine".startswith(e.rstrip("*")) for e in insults)  # near copies still count once


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    yes = F.lit(True)
    for df in (
        mix_sources(docs, ["doc_id"], word_count(F.col("text")), F.col("source")), near_vectors(vectors, "vec_id", "embedding", "label"), scan_licenses(docs, ["doc_id"], "text"),
        score_toxicity(docs, ["doc_id"], "text", fit_grammar(docs, labels, "doc_id", "text", "toxic", yes)), score_quality(docs, "text", fit_quality(docs, labels, "doc_id", "text", "quality", yes), "s"),
        contaminated(docs, ["doc_id"], "text", items, "item_id", "text"), jaccard_join(docs, "doc_id", "text"), find_pii(docs, ["doc_id"], "text"),
        count_tokens(docs, ["doc_id"], "text", PieceCounter.build({"a"}, {"b"})), shard_rows(docs, F.col("text"), ["doc_id"], F.lit(1)),
    ):
        assert df.count() == 0
    some = contaminated(documents(spark), ["doc_id"], "text", items, "item_id", "text")
    assert some.filter("contaminated").count() == 0 and some.count() > 0


def test_names():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 11)}
