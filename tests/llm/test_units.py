"""The parts that need no Spark, against plain versions of themselves."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from stratapoint.llm import embeddings, jaccard, pii, quality, queries, toxicity, wordpiece
from stratapoint.llm.shingles import shingled, slices

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and plain_luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_follow_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("ab1.2@@.+- ()%0é9") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("x 4539 1488 0343 6467 y") == [("card", 2, 21)]


def test_base_spans_of_long_runs_end():
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 100_000, "+" * 100_000, "+1" * 50_000):
        pii.base_spans(t)


def test_piece_counts_agree_with_a_public_word_piece_model():
    models = pytest.importorskip("tokenizers.models")
    rng = random.Random(2)
    for _ in range(60):
        first = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        inner = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        names = [*sorted(first), *("##" + x for x in sorted(inner)), "[UNK]"]
        model = models.WordPiece({x: i for i, x in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=10**6)
        counter = wordpiece.PieceCounter.build(first, inner)
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            want = [t.value for t in model.tokenize(w)]
            assert counter.count(w) == (-1 if want == ["[UNK]"] else len(want))


def plain_pieces(word, pieces, spelled):
    """Greedy longest match over the space mark and a word; a character that no piece begins with is its bytes, or -1."""
    t, n = "▁" + word, 0
    longest = max(map(len, pieces))
    while t:
        k = next((k for k in range(min(longest, len(t)), 0, -1) if t[:k] in pieces), 0)
        if not k and not spelled:
            return -1
        n += 1 if k else len(t[0].encode())
        t = t[k or 1 :]
    return n


def test_whole_pieces_cover_words_by_the_space_mark_and_bytes():
    rng = random.Random(12)
    for trial in range(200):
        pieces = {"".join(rng.choice("▁abñ中") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        counter = wordpiece.PieceCounter.whole(pieces, trial % 2 == 0)
        for _ in range(60):
            w = "".join(rng.choice("▁abñ中😀") for _ in range(rng.randrange(1, 14)))
            assert counter.count(w) == plain_pieces(w, pieces, trial % 2 == 0), (pieces, w)
    counter = wordpiece.PieceCounter.whole({"▁", "▁a", "ñ", "and", "ú"}, True)
    assert counter.text("ñandú añ 😀") == (3, 0, 4 + 2 + 5)


def test_counts_of_the_registered_vocabulary_are_those_of_its_pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    counter = wordpiece.PieceCounter.from_sentencepiece(queries.VOCABULARY)
    for w in ("año", "ñandú", "ça", "être", "Übermäßig", "今天天气很好我们去公园散步", "ｆｕｌｌ", "😀x", "<0x0A>", "plain"):
        assert counter.count(w) == plain_pieces(w, pieces, True), w


def test_shingles_agree_with_sets_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(14))) for _ in range(300)] + [None, "", " \n ", "A b", "a B"]
    s = shingled(pa.array(texts))
    own = [frozenset(s.values[a : a + n].tolist()) for a, n in zip(s.starts, s.counts)]

    def words(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    plain = [words(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in plain]
    for a in range(0, len(texts), 7):
        for b in range(len(texts)):
            assert len(own[a] & own[b]) == len(plain[a] & plain[b])


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 9_000_000, 1, 5_000_000, 2)] + [None])], names=["text"])
    parts = list(slices(iter([batch]), "text"))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) > 2


def test_linked_sets_and_forest():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(60)]
    every = np.arange(60)
    got = jaccard.linked(sets, 0.6, every, every)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (both >= 0.6 * (len(a) + len(b) - both) - 1e-9)
    root = jaccard.forest(got)
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(got)))


def test_prefix_is_shortened_until_the_recall_is_met():
    p = jaccard.JaccardParams()
    d = jaccard.matched_depth(p)
    reach = lambda k: 1 - (1 - p.threshold**k) ** p.trees
    assert reach(d) >= p.recall > reach(d + 1)


def test_multi_sequence_visits_every_cell_within_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = np.abs(rng.normal(size=6)), np.abs(rng.normal(size=5))
        a[0] = b[0] = 0
        got = embeddings.nearest_cells(a, b, 0.8)
        want = {i * 5 + j for i in range(6) for j in range(5) if a[i] ** 2 + b[j] ** 2 <= 0.64}
        assert set(got) == want and len(got) == len(want)


def test_rules_separate_and_are_sparse():
    rng = np.random.default_rng(6)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.8)).astype(float)
    model = quality.fit_rules(x, y, quality.QualityParams())
    z = model.intercept + sum(w * quality.holds(x, r) for w, r in model.rules)
    assert ((z > 0) == y).mean() > 0.98 and 0 < len(model.rules) < 80
    assert quality.fit_rules(x[:5], y[:5], quality.QualityParams()).rules == []


def test_clauses_weigh_negation_report_and_target():
    g = toxicity.Grammar({"idiot": 4.0, "loo*": 3.0}, toxicity.ToxicParams())
    assert g.evidence("a calm text.") is None and g.evidence("") is None
    assert g.evidence("an IDIOT!!") == [4.0, 0, 0, 0, 4.0, 0]
    assert g.evidence("not an idiot")[1] == 4.0 and g.evidence("she said idiot")[2] == 4.0
    assert g.evidence("you idiot")[3] == 4.0 and g.evidence("looserest")[0] == 3.0
    assert g.evidence("he never lies. an idiot")[0] == 4.0  # a clause ends a negation


@pytest.mark.parametrize("text", ["", string.printable, "x" * 100_000])
def test_any_text_has_a_score(text):
    g = toxicity.Grammar({"x*": 1.0}, toxicity.ToxicParams())
    assert 0 <= g.score(g.evidence(text)) <= 1


def test_the_composed_grammar_writes_what_its_transducers_write_in_turn():
    from itertools import product

    from stratapoint.llm import transducers as T

    parts = [T.negation(2), T.report(), T.target(2)]
    whole = T.clause_grammar(2)
    for n in range(1, 6):
        for symbols in product(T.READ, repeat=n):
            want = list(symbols)
            for m in parts:
                want = m.run(want)
            assert whole.run(list(symbols)) == want
    assert T.compose(T.compose(parts[0], parts[1]), parts[2]).run([T.NEGATION, T.OTHER, T.INSULT, T.INSULT, T.END, T.INSULT]) == [T.NEGATION, T.OTHER, "insult negated", "insult", "end", "insult"]


def plain_evidence(grammar, text):
    """The scopes looked up word by word, without states."""
    out, reach = [0.0] * 6, grammar.params.reach
    for line in text.lower().split("\n"):
        clause = []
        for token in [*line.split(), None]:
            if token is not None:
                clause.append(grammar.symbol(token))
            if token is None or clause[-1][2]:
                kinds = [s for s, _, _ in clause]
                heavy = [i for i, k in enumerate(kinds) if k in ("insult", "threat")]
                for i, (k, w, _) in enumerate(clause):
                    before = [j for j in range(max(0, i - reach), i)]
                    if k == "insult":
                        out[1 if any(kinds[j] == "negation" for j in before) else 2 if "report" in kinds[:i] else 0] += w
                        out[4] = max(out[4], w)
                    if k in ("insult", "threat") and any(kinds[j] == "target" for j in before):
                        out[3 if k == "insult" else 5] += w
                    if k == "target" and (last := [j for j in before if j in heavy]):
                        out[3 if kinds[last[-1]] == "insult" else 5] += clause[last[-1]][1]
                clause = []
    return out


def test_evidence_of_whole_texts():
    rng = random.Random(6)
    grammar = toxicity.Grammar({"vermin": 4.0, "scum*": 3.0}, toxicity.ToxicParams())
    lexicon = ["vermin", "scumbag", "you", "not", "said", "kill", "the", "house.", "vermin!", "you.", "“so", "\n", "and", "of"]
    for _ in range(4000):
        text = " ".join(rng.choice(lexicon) for _ in range(rng.randrange(1, 25)))
        got = grammar.evidence(text)
        assert (got or [0.0] * 6) == pytest.approx(plain_evidence(grammar, text) if got else [0.0] * 6), text
    assert grammar.evidence("a clean text") is None and grammar.evidence("") is None
