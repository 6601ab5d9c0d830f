"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon rewrites words into symbols (insult, threat, target, negation, report, end of
clause). Three transducers, composed into one table (``transducers.py``), rewrite the symbols in their scopes: an insult after a
negation, in reported speech, near a target. What the grammar writes is
evidence: every clause's arcs are added up by kind, with the weight of the insult, and the clauses' sums over the text;
the heaviest insult is a kind of its own. A logistic regression weighs the kinds.
The lexicon's insults (words and word beginnings, with their weights) are learned from labelled rows,
and so are the weights of the kinds. Without a match a text scores by the prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import extended, packed, unpacked
from .shingles import per_text, shingled, slices
from .transducers import END, INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, clause_grammar

# fixed values: function words of the grammar in the corpus's languages
TARGETS = "you your yours yourself he him his she her they them their we us people everyone du dich dir dein deine ihr euch sie tu toi te ton vous votre vos ils elles usted ustedes tus vosotros ellos ellas".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie niemals ohne pas jamais aucun sans nunca jamás sin tampoco".split()
REPORTS = "said says say saying wrote writes claimed claims told called quoted quote according reported sagte schrieb laut behauptete dit écrit selon déclaré dijo escribió según afirmó".split()
THREATS = "kill hurt destroy burn murder attack beat shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
EVIDENCE = ("plain", "negated", "reported", "targeted", "heaviest", "threats at targets")
# which kinds of evidence a symbol that the grammar writes is, beside the heaviest insult
KINDS = {INSULT: (0,), f"{INSULT} negated": (1,), f"{INSULT} reported": (2,), f"{TARGET} hit by {INSULT}": (3,), f"{TARGET} hit by {THREAT}": (5,), f"{THREAT} at target": (5,)}
KINDS |= {f"{k} at target": (*v, 3) for k, v in KINDS.items() if k.startswith(INSULT)}
EDGE = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class ToxicParams:
    sample: int = 20000  # labelled rows to fit on, at most
    shortest: int = 3  # letters of a learned word beginning
    longest: int = 7
    support: int = 4  # toxic rows that hold a learned entry, at least
    odds: float = 3.0  # log odds of a learned entry, at least
    z: float = 3.0  # and in standard errors
    explained: float = 0.9  # a word beginning goes if one extension has so large a share of its toxic rows
    entries: int = 20000  # learned entries, at most
    reach: int = 4  # words over which a negation or target acts
    threshold: float = 0.5
    bands: int = 8  # of four independent minima each, for near copies among the rows to fit on
    copied: float = 0.8  # of the minima agree in a near copy, at least


def entries_of(word: str, p: ToxicParams) -> list[str]:
    """A word and its beginnings, which are marked by ``*``."""
    return [word, *(word[:k] + "*" for k in range(p.shortest, min(p.longest, len(word) - 1) + 1))]


@dataclass
class Grammar:
    insults: dict[str, float]
    params: ToxicParams
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(EVIDENCE)))
    intercept: float = -2.0

    def __post_init__(self):
        self._known: dict[str, tuple[str, float, bool]] = {}
        self._fixed = {w: (k, 1.0) for k, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        machine = clause_grammar(self.params.reach)
        self._arcs = {at: (to, KINDS.get(out, ())) for at, (to, out) in machine.arcs.items()}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def symbol(self, token: str) -> tuple[str, float, bool]:
        """What the lexicon writes for one lower-case token: symbol, weight, and whether the clause ends after it."""
        got = self._known.get(token)
        if got is None:
            word = EDGE.sub("", token)
            kind, weight = self._fixed.get(word, (OTHER, 0.0))
            if kind == OTHER and word:
                weight = max((self.insults.get(e, 0.0) for e in entries_of(word, self.params)), default=0.0)
                kind = INSULT if weight else OTHER
            if kind == OTHER and token.startswith(('"', "“", "«")):
                kind, weight = REPORT, 1.0
            got = (kind, weight, token[-1] in ".!?;:")
            if len(self._known) > 400_000:
                self._known.clear()
            if len(token) <= 64:
                self._known[token] = got
        return got

    def evidence(self, text: str) -> list[float] | None:
        """What the grammar's clauses add up to over the whole text; None without an insult or a threat."""
        low, known, symbol = text.lower(), self._known, self.symbol
        if not any((known.get(t) or symbol(t))[0] in (INSULT, THREAT) for t in set(low.split())):
            return None
        out, arcs = [0.0] * len(EVIDENCE), self._arcs
        for line in low.split("\n"):
            state, last = 0, 0.0  # a line begins a clause; the weight of its last insult or threat
            for token in line.split():
                s, w, ends = symbol(token)
                state, kinds = arcs[state, s]
                if s in (INSULT, THREAT):
                    last = w
                    if s == INSULT and w > out[4]:
                        out[4] = w
                for k in kinds:
                    out[k] += last
                if ends:
                    state = arcs[state, END][0]
        return out

    def score(self, evidence: list[float] | None) -> float:
        z = self.intercept if evidence is None else self.intercept + float(self.weights @ squashed(np.array(evidence)))
        return float(1 / (1 + np.exp(-z)))


def squashed(e: np.ndarray) -> np.ndarray:
    return np.log1p(e)


def _features(p: ToxicParams, keep: frozenset | None):
    """Counts of rows that hold an entry, one partial count a batch; with ``keep`` only its entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                words = {EDGE.sub("", w) for w in set((text or "").lower().split())}
                found = {e for w in words for e in entries_of(w, p)}
                for e in found if keep is None else found & keep:
                    n[e] = n.get(e, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])

    return count


def _minima(p: ToxicParams):
    """Adds independent minima of the shingles: the share on which two rows agree estimates their Jaccard similarity."""
    multipliers = np.random.default_rng(5).integers(1, 2**63, 4 * p.bands, dtype=np.uint64) | np.uint64(1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shingled(batch.column("text"))
            least = np.stack([per_text(s, s.values * m, np.minimum) for m in multipliers], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in least], pa.binary())], names=[*batch.schema.names, "minima"])

    return add


def one_of_each(minima: np.ndarray, p: ToxicParams) -> np.ndarray:
    """Rows of minima that are no near copy of an earlier kept row: such rows meet in a band, and are compared on all minima."""
    kept, met = [], {}
    for i, row in enumerate(minima):
        keys = [(b, row[4 * b : 4 * b + 4].tobytes()) for b in range(p.bands)]
        near = np.unique(np.array([j for k in keys for j in met.get(k, ())], np.int64))
        if len(near) and ((minima[near] == row).mean(axis=1) >= p.copied).any():
            continue
        kept.append(i)
        for k in keys:
            met.setdefault(k, []).append(i)
    return np.array(kept, np.int64)


def fit_grammar(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, p: ToxicParams = ToxicParams()) -> Grammar:
    """Learn from at most p.sample labelled rows that ``train`` admits, chosen by a hash of the key; near copies count once."""
    spark = docs.sparkSession
    known = labels.filter(train & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_k")).agg(F.max(f"`{label}`").alias("_y"))
    share = min(1.0, 0.95 * p.sample / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).limit(p.sample)
    rows = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("text")).join(known, "_k").select("text", (F.col("_y") > 0).cast("int").alias("y"), F.col("_k").cast("string").alias("k"))
    every = rows.dropDuplicates().withColumn("h", F.xxhash64("k", "text")).cache()
    seen = every.mapInArrow(_minima(p), "text string, y int, k string, h long, minima binary").select("y", "h", "minima").collect()
    chosen = []
    for y in (0, 1):  # in the order of the hashes, so that a run repeats
        of = sorted((r["h"], bytes(r["minima"])) for r in seen if r["y"] == y)
        if of:
            chosen += [(of[i][0], y) for i in one_of_each(np.frombuffer(b"".join(m for _, m in of), np.uint64).reshape(len(of), -1), p).tolist()]
    rows = every.join(spark.createDataFrame(chosen, "h long, y int"), ["h", "y"]).select("text", "y").cache()
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    every.unpersist()
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        rows.unpersist()
        return Grammar({}, p, intercept=float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else -2.0)
    tally = lambda y, keep: rows.filter(F.col("y") == y).select("text").mapInArrow(_features(p, keep), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    toxic = {r["entry"]: r["n"] for r in tally(1, None).filter(F.col("n") >= p.support).orderBy(F.desc("n"), "entry").limit(p.entries * 10).collect()}
    clean = {r["entry"]: r["n"] for r in tally(0, frozenset(toxic)).collect()}
    insults = {}
    for e, a in toxic.items():
        b = clean.get(e, 0)
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        if odds >= p.odds and odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= p.z and a > 2 * b * n1 / n0:
            insults[e] = float(odds)
    longer: dict[str, int] = {}  # the most rows that one extension of a word beginning accounts for
    for e in insults:
        for short in entries_of(e.rstrip("*"), p):
            if short != e and short.endswith("*"):
                longer[short] = max(longer.get(short, 0), toxic[e])
    insults = {e: w for e, w in insults.items() if longer.get(e, 0) < p.explained * toxic[e]}
    insults = dict(sorted(insults.items(), key=lambda x: (-toxic[x[0]] * x[1], x[0]))[: p.entries])
    grammar = Grammar(insults, p)
    seen = rows.select("text", "y").mapInArrow(_evidence(grammar), "y int, e array<double>").collect()
    rows.unpersist()
    got = sorted((r["y"], r["e"] or [0.0] * len(EVIDENCE)) for r in seen)
    a, y = squashed(np.array([e for _, e in got])), np.array([v for v, _ in got], float)
    grammar.intercept, grammar.weights = _ridge_logistic(a, y)
    return grammar


def _ridge_logistic(a: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[float, np.ndarray]:
    """Newton's method with an L2 penalty, so that separable rows keep finite weights."""
    x = np.hstack([np.ones((len(a), 1)), a])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[strength] * a.shape[1]])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty, x.T @ (y - q) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def _evidence(grammar: Grammar):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            e = [grammar.evidence(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(e, pa.list_(pa.float64()))], names=["y", "e"])

    return read


def score_toxicity(docs: DataFrame, keep: list[str], text: str, grammar: Grammar) -> DataFrame:
    """Kept columns, score (0 to 1) and the evidence found in every whole text; null texts are empty ones. Kept columns named like a result give way to it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            e = [grammar.evidence(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([grammar.score(x) for x in e], pa.float64()), pa.array(e, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "score", "evidence"])

    rows = packed(docs, keep, ["score", "evidence"], text=F.col(f"`{text}`"))
    return unpacked(rows.mapInArrow(score, extended(rows, ["text"], score=T.DoubleType(), evidence=T.ArrayType(T.DoubleType()))), "score", "evidence")
