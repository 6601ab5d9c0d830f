"""Recall of the n-gram join just above the threshold, ties of the forest included, against all pairs."""

import numpy as np

from stratapoint.llm.jaccard import JaccardParams, jaccard_join, matched_depth, trees_for
from test_operators import WORDS, plain_links

RNG = np.random.default_rng(12)


def pairs(n):
    """Pairs of texts with a similarity of 0.8 to 0.87."""
    out = []
    for _ in range(n):
        w = list(RNG.choice(WORDS, 120))
        v = list(w)
        for at in RNG.choice(np.arange(10, 110), int(RNG.integers(2, 4)), replace=False):
            v[at] = "changed"
        out += [" ".join(w), " ".join(v)]
    return out


def test_links_at_the_threshold_are_found(spark):
    texts = pairs(300)
    links = plain_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {(i, len(x)) for i, x in enumerate(links)}
    assert sum(bool(x) for x in links) > 200
    got = {(r["doc_id"], r["n_links"]) for r in jaccard_join(docs, "doc_id", "text").collect()}
    assert len(got & want) >= 0.995 * len(want) and sum(n for _, n in got - want) <= sum(n for _, n in want - got)


def test_crowded_prefixes_are_lengthened_without_losing_links(spark):
    """All texts share a long passage, so that short prefixes are crowded; only some are links."""
    common = list(RNG.choice(WORDS, 80))
    texts = [" ".join([*common, *RNG.choice(WORDS, 45)]) for _ in range(120)]
    texts += [t.rsplit(" ", 3)[0] + " " + " ".join(RNG.choice(WORDS, 3)) for t in texts[:40]]
    links = plain_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for p in (JaccardParams(node_rows=10), JaccardParams(node_rows=10, leaders=4, block=16)):
        got = {r["doc_id"]: r["n_links"] for r in jaccard_join(docs, "doc_id", "text", p).collect()}
        assert [got[i] for i in range(len(texts))] == [len(x) for x in links]


def test_the_forests_have_the_recall_asked_for():
    p = JaccardParams()
    for depth, trees in ((matched_depth(p), p.trees), (p.depth, trees_for(p, p.depth))):
        assert 1 - (1 - p.threshold**depth) ** trees >= p.recall
