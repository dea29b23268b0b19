"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Boosted shallow trees over text statistics give conjunctive rules (the paths to all their nodes); an L1-penalised
logistic regression keeps few of them; the kept rules and weights become one column expression, so scoring runs in
generated code over whole texts without Python.

Null text counts as empty; empty texts have the statistics of an empty text and a score like any other. Repeated rows are
scored alike. At most ``max_rows`` labelled rows' statistics, chosen by a hash of their ids, are gathered for training.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, TREES, DEPTH, BINS, RATE, MIN_LEAF, MAX_RULES = 8000, 40, 3, 32, 0.3, 8, 40


def statistics(text: Column) -> dict[str, Column]:
    """Name to expression, all doubles; one pass of each pattern over the text."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.split(text, r"\s+")
    n_words = F.size(words).cast("double")
    lines = F.split(text, "\n")
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("double")
    return {
        "chars": F.log1p(F.char_length(text).cast("double")),
        "letters": left(r"[^\p{L}]+") / n,
        "upper": left(r"[^\p{Lu}]+") / n,
        "digits": left("[^0-9]+") / n,
        "symbols": left(r"[\p{L}0-9\s.,;:'\"()?-]+") / n,
        "word_chars": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_word_room": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_chars": F.log1p(n / F.size(lines)),
        "stops": (F.char_length(text) - F.char_length(F.replace(text, F.lit("."), F.lit("")))) / n_words,
        "marks": (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))) / n_words,
    }


@dataclass(frozen=True)
class Rule:
    """All of ``parts`` (statistic, threshold, above) hold; above: value > threshold, else value <= threshold."""

    parts: tuple[tuple[str, float, bool], ...]

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(columns[s] > t) == above for s, t, above in self.parts])

    def column(self, of: Callable[[str], Column]) -> Column:
        out = None
        for s, t, above in self.parts:
            one = of(s) > F.lit(t) if above else of(s) <= F.lit(t)
            out = one if out is None else out & one
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float


def _tree(x: np.ndarray, cuts: list[np.ndarray], names: list[str], grad: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Rules of all nodes of one tree on binned statistics, and the values of its leaves by row."""
    rules, value = [], np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        parts, rows = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        value[rows] = -g / (h + 1)
        if parts:
            rules.append(Rule(tuple(sorted(parts))))
        if len(parts) == DEPTH or len(rows) < 2 * MIN_LEAF:
            continue
        best = (1e-3, None, None)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            gs = np.cumsum(np.bincount(x[rows, j], weights=grad[rows], minlength=len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(x[rows, j], weights=hess[rows], minlength=len(cut) + 1))[:-1]
            ns = np.cumsum(np.bincount(x[rows, j], minlength=len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is not None:
            _, j, k = best
            above = x[rows, j] > k
            todo += [((*parts, (names[j], float(cuts[j][k]), True)), rows[above]), ((*parts, (names[j], float(cuts[j][k]), False)), rows[~above])]
    return rules, value


def fit(columns: dict[str, np.ndarray], y: np.ndarray) -> Model:
    y = y.astype(float)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(y) or y.min() == y.max():
        return Model((), (), prior)
    names = list(columns)
    cuts = [np.unique(np.quantile(columns[s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in names]
    x = np.stack([np.searchsorted(c, columns[s], "left") for s, c in zip(names, cuts, strict=True)], axis=1)  # bin > k: value > cuts[k]
    z, found = np.full(len(y), prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rules, value = _tree(x, cuts, names, p - y, p * (1 - p))
        found |= dict.fromkeys(rules)
        z += RATE * value
    rules = list(found)
    held = np.stack([r.holds(columns) for r in rules], axis=1).astype(float)
    mean, spread = held.mean(axis=0), held.std(axis=0)
    use = spread > 0
    rules, held, mean, spread = [r for r, u in zip(rules, use, strict=True) if u], held[:, use], mean[use], spread[use]
    if not rules:
        return Model((), (), prior)
    a = (held - mean) / spread
    penalty, step = 0.002, 4.0 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    while True:
        w, v, bias, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), prior, 1.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-(a @ v + bias)))
            new = v - step * (a.T @ (p - y)) / len(y)
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
            bias -= (p - y).mean()
            grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / grown * (new - w), new, grown
        kept = np.flatnonzero(np.abs(w) > 1e-6)
        if len(kept) <= MAX_RULES:
            break
        penalty *= 1.5
    weights = w[kept] / spread[kept]
    return Model(tuple(rules[i] for i in kept), tuple(float(x) for x in weights), float(bias - weights @ mean[kept]))


def score_column(model: Model, of: Callable[[str], Column]) -> Column:
    """The score as a column; ``of`` gives the column of a statistic."""
    z = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        z = z + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row; only statistics that a kept rule uses are computed."""
    stats = df.select(F.col(id_col).alias("doc_id"), F.struct(*[v.alias(k) for k, v in statistics(F.col(text_col)).items()]).alias("s"))
    return stats.select("doc_id", score_column(model, lambda k: F.col(f"s.{k}")).alias("score"))


def train(documents: DataFrame, labels: DataFrame, *, label_col: str = "quality", usable: Callable[[Column], Column] = lambda doc_id: F.lit(True), max_rows: int = MAX_ROWS) -> Model:
    wanted = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    stats = statistics(F.col("text"))
    rows = documents.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "label", *[v.alias(k) for k, v in stats.items()]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit({k: np.array([r[k] for r in rows], dtype=float) for k in stats}, np.array([r["label"] for r in rows], dtype=float))
