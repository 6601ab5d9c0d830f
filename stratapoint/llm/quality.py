"""Quality by a sparse rule ensemble.

Statistics of the whole text are Spark columns. Boosted trees on a bounded sample
of labelled rows give paths; every path is a conjunctive rule; a lasso logistic
regression weighs the rules; rules with a weight become one Spark column expression, so
that scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import word_count


@dataclass(frozen=True)
class QualityParams:
    sample: int = 12000  # labelled rows to fit on, at most
    trees: int = 24
    depth: int = 3
    bins: int = 32
    leaf: float = 0.01  # of the sample, that a path must hold
    shrink: float = 0.3
    lasso: float = 0.0015
    rounds: int = 400
    threshold: float = 0.7


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Numbers in closed form over the whole text; every one is defined for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per = F.greatest(n, F.lit(1)).cast("double")
    words = word_count(text)
    each = F.greatest(words, F.lit(1)).cast("double")
    lines, tokens = F.split(t, "\n"), F.split(F.lower(t), r"[\x20\x09-\x0D]+")
    n_lines = F.size(lines)
    return {
        "log_words": F.log1p(words.cast("double")),
        "word_length": n / each,
        "upper": 1 - _left(t, r"\p{Lu}+") / per,
        "letters": 1 - _left(t, r"\p{L}+") / per,
        "digits": 1 - _left(t, r"[0-9]+") / per,
        "sentence_marks": 1 - _left(t, r"[.,;:?]+") / per,
        "exclaims": 1 - F.length(F.translate(t, "!", "")) / per,
        "bars": 1 - F.length(F.translate(t, "|", "")) / per,
        "symbols": 1 - F.length(F.translate(t, "#$%&*<>{}[]\\^~=+_@", "")) / per,
        "words_a_line": each / n_lines,
        "new_lines": F.size(F.array_distinct(lines)) / n_lines.cast("double"),
        "new_words": F.size(F.array_distinct(tokens)) / each,
        "words_by_root": F.size(F.array_distinct(tokens)) / F.sqrt(each),
    }


Condition = tuple[int, bool, float]  # statistic, above, cut


def grow_paths(x: np.ndarray, y: np.ndarray, p: QualityParams) -> list[tuple[Condition, ...]]:
    """All paths, leaves' and inner nodes', of boosted trees on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # x <= cut i iff code <= i
    raw = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    least, paths = max(5.0, p.leaf * len(y)), {}
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        todo = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            best = (1e-6, None)
            if len(path) < p.depth:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    k = code[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
            if best[1] is None:
                raw[rows] += p.shrink * g[rows].sum() / (h[rows].sum() + 1)
                continue
            j, i = best[1]
            for above in (False, True):
                step = (*path, (j, above, float(cuts[j][i])))
                paths[tuple(sorted(step))] = None
                todo.append((rows[(code[rows, j] > i) == above], step))
    return list(paths)


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) == above for j, above, cut in rule])


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float, rounds: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is free."""
    a1 = np.hstack([np.ones((len(a), 1)), a])
    top = np.ones(a1.shape[1])
    for _ in range(30):  # the largest eigenvalue, from below
        top = a1.T @ (a1 @ (top / np.linalg.norm(top)))
    step = 4 * len(y) / (1.05 * np.linalg.norm(top) + 1e-9)
    w = v = np.zeros(a1.shape[1])
    for k in range(1, rounds + 1):
        new = v - step * (a1.T @ (1 / (1 + np.exp(-(a1 @ v))) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        v, w = new + (k - 1) / (k + 2) * (new - w), new
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def column(self, stats: list[Column]) -> Column:
        """The probability of label 1 as one expression."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            test = reduce(lambda p, q: p & q, [(stats[j] > F.lit(cut)) if above else (stats[j] <= F.lit(cut)) for j, above, cut in rule])
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, p: QualityParams) -> RuleModel:
    """With no rows, or one label only, the model is the share of label 1 (0.5 without rows)."""
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    rules = grow_paths(x, y, p)
    a = np.stack([holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, w = lasso_logistic(a, y, p.lasso, p.rounds)
    return RuleModel(intercept, [(float(c), r) for c, r in zip(w, rules) if abs(c) > 1e-6])


def fit_quality(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, p: QualityParams = QualityParams()) -> RuleModel:
    """Fit on at most p.sample labelled rows that ``train`` admits, chosen by a hash of the key."""
    known = labels.filter(train & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_k")).agg(F.max(f"`{label}`").alias("_y"))
    n = known.count()
    share = min(1.0, 0.95 * p.sample / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).limit(p.sample)
    stats = statistics(F.col("_t"))
    found = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).join(known, "_k").select("_y", *[c.alias(f"_{k}") for k, c in stats.items()])
    got = np.array([[float(v) for v in r] for r in found.limit(p.sample).collect()]).reshape(-1, len(stats) + 1)
    got = got[np.lexsort(got.T)]
    return fit_rules(got[:, 1:], (got[:, 0] > 0).astype(float), p)


def score_quality(docs: DataFrame, text: str, model: RuleModel, score: str) -> DataFrame:
    """docs with the score of every whole text; a null text is scored as an empty one. Columns may have any names that don't begin with ``_stat_``."""
    stats = statistics(F.col(f"`{text}`"))
    used = sorted({j for _, rule in model.rules for j, _, _ in rule})
    names = list(stats)
    out = docs.withColumns({f"_stat_{j}": stats[names[j]] for j in used})
    cols = [F.col(f"_stat_{j}") for j in range(len(names))]
    return out.withColumn(score, model.column(cols)).drop(*[f"_stat_{j}" for j in used])
