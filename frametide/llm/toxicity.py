"""Toxicity: a bag of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (and of itself), hashed into a fixed table, so an
unseen misspelling shares most of its vectors with the word it disguises. Words are averaged over
windows of a text, and the text's score is that of its most toxic window: a single average over a
long text would drown a few insults. Embeddings and softmax weights are trained together, from noise; as both classes'
logits are linear in the average, scoring needs one number per n-gram.

Null and empty texts have no words and get the score of an empty average (the prior). Repeated rows are scored alike. At most
``max_positive`` + ``max_negative`` labelled texts, chosen by a hash of their ids, are gathered for training.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, WINDOW, GRAMS = 1 << 20, 16, 25, (3, 4, 5, 6)
MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
#: Distinct words whose scores a task keeps.
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(word: str) -> list[int]:
    data = f"<{word}>"
    grams = {data} | {data[i : i + n] for n in GRAMS for i in range(len(data) - n + 1)}
    return [zlib.crc32(x.encode()) % BUCKETS for x in sorted(grams)]


@dataclass(frozen=True)
class Model:
    """``gram``: each n-gram's part of the difference of the two logits; the score is sigmoid(scale * (max window + bias) + shift)."""

    gram: np.ndarray
    bias: float
    scale: float
    shift: float


class WordScores(dict):
    """Distinct words' parts of the logit, computed when they are first asked for."""

    def __init__(self, gram: np.ndarray):
        super().__init__()
        self.gram = gram

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = float(self.gram[subwords(word)].mean())
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, WordScores(model.gram)

    def logit(self, text: str | None) -> float:
        words = words_of(text)
        if not words:
            return self.model.bias
        parts = np.fromiter(map(self.words.__getitem__, words), float, len(words))
        starts = np.arange(0, len(parts), WINDOW)
        return float((np.add.reduceat(parts, starts) / np.minimum(WINDOW, len(parts) - starts)).max()) + self.model.bias

    def score(self, texts) -> np.ndarray:
        z = self.model.scale * np.array([self.logit(x) for x in texts], dtype=float) + self.model.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], *, rounds: int = 100, bootstrap: int = 30, keep: float = 0.02, least_kept: int = 256, rate: float = 0.05, momentum: float = 0.9, decay: float = 1e-5, min_share: float = 0.01, least: int = 3, noise: float = 1e-2, seed: int = 7) -> Model:
    """Train on whole texts. First all windows carry their text's label; then each text counts by its most toxic window.

    Every n-gram that is in ``min_share`` of the texts (and in ``least``) begins as noise and is trained jointly with the softmax weights, whatever its labels; rarer ones
    could only be learnt by heart. An n-gram's part is divided by the root of its frequency, so that common ones do not drown the others. Gradient steps
    have momentum and shrink with the largest gradient seen. After ``rounds`` steps only the share ``keep`` of the n-grams (``least_kept`` at least) that have learnt the strongest parts stays, and is
    trained on for as many steps: the parts of the others are noise.
    """
    y = np.array(labels, dtype=float)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int32) for t in texts]
    if not vocabulary or y.min() == y.max():
        rate_1 = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 1.0, float(np.log(rate_1 / (1 - rate_1))))
    n_subs = np.zeros(len(vocabulary), dtype=np.int64)
    grams = array("i")
    for i, w in enumerate(vocabulary):
        own = subwords(w)
        n_subs[i] = len(own)
        grams.extend(own)
    flat = np.frombuffer(grams, dtype=np.int32)
    starts = np.concatenate([[0], np.cumsum(n_subs)])
    seen = np.zeros(BUCKETS)
    for d in docs:
        if len(d):
            seen[np.unique(np.concatenate([flat[starts[w] : starts[w + 1]] for w in np.unique(d)]))] += 1
    used = seen >= max(least, min_share * len(docs))
    place = np.cumsum(used) * used  # row of each n-gram that is used; row 0 stays zero
    rows = int(place.max()) + 1
    entries = np.flatnonzero(used[flat])  # the n-grams that count, and the words they stand in
    gram_of, word_of = place[flat[entries]], (np.searchsorted(starts, entries, "right") - 1)
    del flat, grams, entries
    white = np.concatenate([[0.0], 1 / np.sqrt(seen[used] / seen[used].mean())]) if used.any() else np.zeros(1)
    tokens = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs])
    doc_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    w_start = np.concatenate([s + np.arange(0, n, WINDOW) for s, n in zip(doc_start, lengths, strict=True)]).astype(np.int64)
    n_windows = -(-lengths // WINDOW)
    w_doc = np.repeat(np.arange(len(docs)), n_windows)
    w_len = np.minimum(WINDOW, (doc_start + lengths)[w_doc] - w_start)
    token_w = np.repeat(np.arange(len(w_start)), w_len)
    have = np.unique(w_doc)
    w_first = np.searchsorted(w_doc, have)
    rng = np.random.default_rng(seed)
    u, bias = rng.normal(0, 1, DIM), 0.0  # u: difference of the two classes' softmax weights
    u /= np.linalg.norm(u)
    e = rng.uniform(-noise, noise, (rows, DIM))
    e[0] = 0
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def forward() -> np.ndarray:
        part = WINDOW * np.bincount(word_of, weights=(white * (e @ u))[gram_of], minlength=len(n_subs)) / n_subs  # a word's mean of its n-grams' parts of the logit
        return np.add.reduceat(part[tokens], w_start) / w_len + bias

    for first in (bootstrap, 0):
        m_e, m_u, size = np.zeros_like(e), np.zeros(DIM), 1e-12
        for step in range(first + rounds):
            z = forward()
            weight = np.zeros(len(z))
            if step < first:
                weight[:] = balance[w_doc] / n_windows[w_doc]
            else:
                best = np.lexsort((-z, w_doc))[w_first]
                weight[best] = balance[w_doc[best]]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[w_doc]) * weight
            of_word = np.bincount(tokens, weights=(error / w_len)[token_w], minlength=len(n_subs))
            of_gram = WINDOW * white * np.bincount(gram_of, weights=(of_word / n_subs)[word_of], minlength=rows)
            d_e, d_u = np.outer(of_gram, u) + decay * e, of_gram @ e
            m_e, m_u = momentum * m_e + (1 - momentum) * d_e, momentum * m_u + (1 - momentum) * d_u
            size = max(size, float(np.sqrt((d_e**2).sum(axis=1).mean())))
            e -= rate * m_e / size
            u -= 0.1 * rate * m_u / (np.linalg.norm(d_u) + 1e-9)
            bias -= error.sum()
        if first:
            strength = np.abs(e @ u) * (white > 0)
            weak = np.argsort(-strength, kind="stable")[max(least_kept, int(keep * (rows - 1))) :]
            white[weak] = 0.0
    z = forward()
    scale, shift = _calibrate(np.maximum.reduceat(z, w_first), y[have])
    return Model((WINDOW * white * (e @ u))[place].astype(np.float32), float(bias), scale, shift)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the logits, with a slight pull to a finite slope."""
    centre, spread = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - centre) / spread, np.ones(len(z))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-3])
        beta -= np.linalg.solve(hessian, x.T @ (p - y) + np.array([0.05, 1e-3]) * beta)
    scale = max(float(beta[0]), 0.0) / spread
    return scale, float(beta[1]) - scale * centre


def train(documents: DataFrame, labels: DataFrame, *, label_col: str = "toxic", usable: Callable[[Column], Column] = lambda doc_id: F.lit(True), max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model:
    """Fit on the labelled documents for which ``usable(doc_id)`` holds; at most the stated numbers of each class."""
    wanted = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable(F.col("doc_id"))).dropDuplicates(["doc_id"])
    some = [wanted.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_positive), (0, max_negative))]
    sample = documents.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")  # bounded by the two limits
    rows = sorted((r["doc_id"], r["label"], r["text"] or "") for r in sample.collect())
    return fit([r[2] for r in rows], [r[1] for r in rows]) if rows else Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 1.0, 0.0)


def score_column(model: Model) -> Callable[[Column], Column]:
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.score(texts))

    return score
