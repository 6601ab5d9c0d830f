"""Bootstrapped extraction against a plain version of the whole pattern-instance graph, and what it adds to the base spans."""

import collections
import hashlib
import random

from stratapoint.llm.pii import KINDS, PiiParams, base_spans, find_pii, form, joined, luhn, occurrences
from stratapoint.llm.queries import op8_pii

R = random.Random(4)
WORDS = ["".join(R.choice("abdeilnorstu") for _ in range(R.randrange(2, 8))) for _ in range(200)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def card():
    while True:
        d = "4" + "".join(R.choice("0123456789") for _ in range(15))
        if luhn(d):
            return d


def corpus():
    """Known identifiers, decoys of their shape, and identifiers that the base patterns pass over."""
    texts, added = [], {}
    cards = [card() for _ in range(40)]
    phones = [f"+1 ({R.randrange(100, 999)}) 555-{R.randrange(1000, 9999)}" for _ in range(30)]
    for c in cards:
        texts.append(f"{prose(6)} {c} {prose(5)}")
    texts += [f"{prose(4)} {x} {prose(4)}" for x in phones]
    texts += [f"{prose(3)} {R.randrange(10**15, 10**16)} {prose(3)}" for _ in range(40)]  # most fail the check
    texts += [f"{prose(3)} id {R.randrange(1, 99)} {prose(2)} version {R.randrange(9)}.{R.randrange(9)} {prose(2)}" for _ in range(40)]
    for c in cards[:6]:  # two numbers side by side, which the base pattern reads as one
        t = f"{prose(5)} {c} {card()} {prose(3)}"
        added[t] = ("card", 2)
    for x in phones[:4]:
        t = f"{prose(5)} {x.replace(' ', chr(10), 1)} {prose(3)}"
        added[t] = ("phone", 1)
    for i in range(20):
        texts.append(f"{prose(3)} reach hotline +44 {R.randrange(10**6, 10**7)} {prose(2)}")
    for i in range(4):
        t = f"{prose(3)} reach hotline 0{R.randrange(10**6, 10**7)} {prose(2)}"
        added[t] = ("phone", 1)
    texts += [*added, None, "", prose(6000) + " hotline 07654321 " + "x" * 100000, texts[0], texts[0]]
    R.shuffle(texts)
    return texts, added


def plain(texts, p):
    """The same rounds with dictionaries over all places at once."""
    places = [[o for o in occurrences(t or "", base_spans(t or ""), p)] for t in texts]
    edges = collections.defaultdict(lambda: [False, None, None])  # (pattern, instance): main, kind, possible
    for rows in places:
        for kind, _, _, surface, kinds, told, main in rows:
            for x in told:
                e = edges[x, surface]
                e[0] |= main
                e[1] = max(filter(None, (e[1], kind)), default=None)
                e[2] = e[2] or kinds
    label = {}
    for (_, surface), (_, kind, _) in edges.items():
        if kind:
            label[surface] = (max(kind, label.get(surface, ("",))[0]), 1.0)
    while True:
        of = collections.defaultdict(list)
        for (x, surface), (main, _, kinds) in edges.items():
            if main:
                of[x].append((label.get(surface), kinds))
        strong = {}
        for x, found in of.items():
            for k in KINDS:
                s = sum(f[1] for f, _ in found if f and f[0] == k)
                n = sum(1 for f, _ in found if f and f[0] == k)
                against = sum(1.0 if f or k not in kinds else p.unknown for f, kinds in found)
                strong[x] = max(strong.get(x, (0, 0, "")), (s / against, n, k))
        strong = {x: (s, k) for x, (s, n, k) in strong.items() if n >= p.support and s >= p.confidence}
        new = {}
        for (x, surface), (_, _, kinds) in edges.items():
            if surface not in label and x in strong and strong[x][1] in kinds:
                new[surface] = max(new.get(surface, (0, "")), strong[x])
        if not new:
            break
        label |= {s: (k, v) for s, (v, k) in new.items()}
    out = []
    for rows, t in zip(places, texts):
        more, end = [], 0
        for a, b, k in sorted(((a, -b, label[s][0]) for kind, a, b, s, kinds, _, _ in rows if kind is None and s in label and label[s][0] in kinds)):
            if a >= end:
                more.append((k, a, -b))
                end = -b
        out.append(joined(base_spans(t or "") + more))
    return out


def test_the_whole_graph(spark):
    texts, added = corpus()
    p = PiiParams(support=5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in find_pii(docs, ["doc_id"], "text", p).collect()}
    want = plain(texts, p)
    assert [got[i]["spans"] for i in range(len(texts))] == want
    more = {t: [x for x in got[i]["spans"].split(",") if x and x not in joined(base_spans(t))] for i, t in enumerate(texts) if t}
    for t, (kind, n) in added.items():
        assert [x.split(":")[0] for x in more[t]] == [kind] * n, (t, more[t])
    wrong = [x for t, xs in more.items() if t not in added and "hotline" not in t for x in xs]
    assert not wrong  # precision of what is added


def test_the_query_counts_base_spans(spark, tmp_path):
    texts, added = corpus()
    at = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    got = op8_pii(spark, at).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        base = base_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
    assert any(len(r["spans"].split(",")) > r["n_card"] == 0 for r in got if texts[r["doc_id"]] in added)  # the method's spans are there, beside the counts


def test_forms():
    assert form("4539148803436467") == "d16 L" and form("4539148803436468") == "d16 " and form("10.0.0.1") == "d2.d1.d1.d1 I"
    assert form("+1\n(132) 555-1352") == "+d1 (d3) d3-d4 " and form("nt.26@mail6.example.com") == "a.d2@ad1.a.a "
