"""Decontamination and license scans against all windows by brute force, reordered and short passages included."""

import collections
import re

import numpy as np
import pytest

from stratapoint.llm.decontaminate import SimHashParams, contaminated, fingerprint, lane_of
from stratapoint.llm.licenses import LicenseParams, scan_licenses

RNG = np.random.default_rng(31)
WORDS = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "io", "u", "an")]


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words, n))


def grams(text, k):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def shape(text):
    k = min(5, len(re.sub(r"[\W_]+", " ", (text or "").lower()).split()))
    return k, grams(text, k) if k else []


def all_windows(text, k, m):
    g = grams(text, k)
    return [(i, g[i : i + m]) for i in range(max(1, len(g) - m + 1))] if g else []


def best_similarity(text, item):
    k, hs = shape(item)
    if not hs:
        return 0.0
    want = collections.Counter(hs)
    both = lambda w: sum((collections.Counter(w) & want).values())
    return max((b / (len(w) + len(hs) - b) for _, w in all_windows(text, k, len(hs)) for b in [both(w)]), default=0.0)


def edited(item):
    """Passages made of an item: reordered, cut, with words changed, put in, left out, doubled; alone or in other prose."""
    w, n = item.split(), len(item.split())
    yield from (w, w[n // 2 :] + w[: n // 2], w[n // 3 :] + w[: n // 3], w[: n - 3], w[3:], w[: n // 2], w + w, [*w[: n // 2], "new", *w[n // 2 :]], [*w[: n // 2], *w[n // 2 + 1 :]], ["x", *w[1:-1], "y"])
    for share in (0.01, 0.02, 0.03, 0.05):
        yield [x if RNG.random() > share else "other" for x in w]


def passages(items):
    out = [None, "", " ", "one", prose(4000), prose(300)]
    for item in items:
        for w in edited(item):
            out += [" ".join(w), prose(int(RNG.integers(1, 40))) + " " + " ".join(w) + ". " + prose(int(RNG.integers(1, 40)))]
    return out + out[-3:]


ITEMS = [prose(100), prose(60), prose(24), prose(11), prose(5), "two words", "alone", "lo lo lo lo lo lo lo lo lo lo lo lo", prose(30, WORDS[:3])]


def test_decontamination_of_all_windows(spark):
    texts = passages(ITEMS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([*enumerate(ITEMS), (90, None), (91, " ")], "item_id long, text string")
    got = {r["doc_id"]: r for r in contaminated(docs, ["doc_id"], "text", items, "item_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        like = [best_similarity(t, x) for x in ITEMS]
        want = [j for j, s in enumerate(like) if s >= 0.8 - 1e-12]
        assert got[i]["items"] == want, (t, got[i])
        assert got[i]["similarity"] == pytest.approx(max([like[j] for j in want], default=0.0))


def test_halves_of_an_item_in_the_other_order_are_found(spark):
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words[50:] + words[:50])
    docs = spark.createDataFrame([(0, text), (1, "so it is " + text + " and so on")], "doc_id long, text string")
    got = contaminated(docs, ["doc_id"], "text", spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"), "item_id", "text").collect()
    assert all(r["items"] == [7] and r["similarity"] == pytest.approx(92 / 100) for r in got)
    assert all(r["licenses"] == ["L"] for r in scan_licenses(docs, ["doc_id"], "text", {"L": [" ".join(words)]}).collect())


def test_licenses_of_all_windows(spark):
    templates = {f"T{i % 4}": ITEMS[i::4] for i in range(4)}
    texts = passages(ITEMS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in scan_licenses(docs, ["doc_id"], "text", templates).collect()}
    for i, t in enumerate(texts):
        want = set()
        for name, ts in templates.items():
            for x in ts:
                k, hs = shape(x)
                want |= {(at, name) for at, w in all_windows(t, k, len(hs)) if len(set(w) & set(hs)) >= 0.8 * len(set(hs)) - 1e-9}
        assert [tuple(x) for x in got[i]["starts"]] == sorted(want) and got[i]["licenses"] == sorted({n for _, n in want}), t


def test_fingerprints_are_simhashes_in_every_lane_width(spark):
    rows = [(i, [int(h) for h in RNG.integers(-(2**63), 2**63, n)]) for i, n in enumerate((1, 2, 7, 40, 63))]
    df = spark.createDataFrame(rows, "i int, hs array<long>")
    for lane in (8, 16, 32):
        got = {r["i"]: r["fp"] % 2**64 for r in df.select("i", fingerprint("hs", lane).alias("fp")).collect()}
        for i, hs in rows:
            assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert [lane_of(n) for n in (0, 63, 64, 16383, 16384)] == [8, 8, 16, 16, 32]


def test_recall_of_the_fingerprints_at_the_threshold():
    """Of pairs with a weighted Jaccard similarity just at the threshold, the radius and the bands lose less than one in a thousand."""
    p, n = SimHashParams(), 4000
    lost = 0
    for _ in range(n):
        h = RNG.integers(0, 2**63, 55, dtype=np.uint64) * np.uint64(2) + RNG.integers(0, 2, 55, dtype=np.uint64)
        a, b = h[:50], h[5:]  # 45 of 55: 0.82
        bits = lambda x: (x[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(0) * 2 > len(x)
        lost += (bits(a) != bits(b)).sum() > p.radius
    assert lost <= n / 1000
    assert all(1 - (1 - j**rows) ** bands >= 0.99999 for j in (0.1, 0.5, 2 / 3) for bands, rows in [LicenseParams().shape(j)])
