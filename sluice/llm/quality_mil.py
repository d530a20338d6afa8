"""Operator 8: document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded from what its
words look like (length, case, signs, repetition) by a tanh layer; gated attention,
    a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))),
weighs the passages, and a logistic unit scores the weighted sum. All of it is learnt from
document labels alone, in numpy by Adam. Every passage of the whole text takes part.

Defined cases: null and blank texts are one empty passage and get a score; without
labels of both classes every score is 1, so that nothing is rejected; texts of any length
are scored whole, their words in steps; a score equal to the threshold is kept; repeated rows score alike;
a null doc_id stays null and is not held out; an empty table gives an empty result; columns of any other name
are kept by `keep_good` and not read by `classify`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out, labelled_sample, score_column

PASSAGE = 32
HIDDEN, GATE = 24, 12
#: Labelled documents of class 0 and 1 that the model is fitted on, at most.
PER_CLASS = (1000, 1500)
REMEMBERED = 200_000
SIGNS = frozenset("#*$%&|<>~^_=@{}[]\\")
#: Features of a word, then of a passage.
WORD_FEATURES, FEATURES = 10, 15


def look(word: str) -> tuple[float, ...]:
    """What a word looks like, without what it is."""
    n = len(word)
    if word.isalpha():  # no signs and no digits in it
        return (min(n, 40) / 10, float(n > 1 and word.isupper()), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, float(word[0].isupper()), float(n <= 3))
    bare = word.rstrip(".,;:!?")
    signs = sum(c in SIGNS for c in word)
    return (
        min(n, 40) / 10, float(n > 1 and word.isupper()), float(signs > 0), float(signs == n), float(word[-1] == "!"),
        float(any(c.isdigit() for c in word)), float(bare.isalpha()), float(word[-1] in ".?"), float(word[0].isupper()), float(n <= 3),
    )


class Encoder:
    """Passage features of texts; the looks of words are remembered."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.looks = np.zeros((1 << 10, WORD_FEATURES), np.float32)

    def passages(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.zeros((1, FEATURES), np.float32)
        number = self.number
        new = set(words).difference(number)
        if new:
            if len(number) + len(new) > REMEMBERED:
                number.clear()
                new = set(words)
            while len(number) + len(new) > len(self.looks):
                self.looks = np.concatenate([self.looks, np.zeros_like(self.looks)])
            for w in sorted(new):
                self.looks[len(number)] = look(w)
                number[w] = len(number)
        index = np.fromiter(map(number.__getitem__, words), np.int64, n)
        first = np.arange(0, n, PASSAGE)
        size = np.diff(np.r_[first, n]).astype(np.float32)
        out = np.empty((len(first), FEATURES), np.float32)
        for at in range(0, len(first), 4096):  # a bounded part of a long text at a time
            words_at = first[at : at + 4096] - first[at]
            part = index[first[at] : first[at] + PASSAGE * 4096]
            out[at : at + 4096, :WORD_FEATURES] = np.add.reduceat(self.looks[part], words_at, axis=0)
        out[:, :WORD_FEATURES] /= size[:, None]
        table = np.full(len(first) * PASSAGE, -1)
        table[:n] = index
        table = table.reshape(-1, PASSAGE)
        same = (table[:, 1:] == table[:, :-1]) & (table[:, 1:] >= 0)
        ordered = np.sort(table, axis=1)
        changed = (ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] >= 0)
        distinct = changed.sum(1) + (ordered[:, 0] >= 0)
        out[:, 10] = distinct / size
        out[:, 11] = same.sum(1) / size
        out[:, 12] = size / PASSAGE
        out[:, 13] = np.log1p(n) / 10
        out[:, 14] = len(np.unique(index)) / n
        return out


def softmax_by(x: np.ndarray, bag: np.ndarray, first: np.ndarray) -> np.ndarray:
    e = np.exp(x - np.maximum.reduceat(x, first)[bag])
    return e / np.add.reduceat(e, first)[bag]


@dataclass
class Model:
    """mean, scale: of the features; the rest: weights of the layers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, first: np.ndarray) -> tuple:
        wh, bh, v, u, w, wo, bo = self.weights
        h = np.tanh(x @ wh + bh)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        a = softmax_by((tv * su) @ w, bag, first)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, tv, su, a, z, 1 / (1 + np.exp(-np.clip(z @ wo + bo, -60, 60)))

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Scores of documents from their passages' features."""
        if not features:
            return np.zeros(0)
        if not self.weights:
            return np.ones(len(features))
        x = (np.concatenate(features) - self.mean) / self.scale
        sizes = [len(f) for f in features]
        first = np.cumsum([0, *sizes[:-1]])
        return self.forward(x, np.repeat(np.arange(len(sizes)), sizes), first)[-1].astype(float)


def gradients(model: Model, x: np.ndarray, bag: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted log loss of documents, and its gradient by each of the model's weights."""
    wh, bh, v, u, w, wo, bo = model.weights
    h, tv, su, a, z, p = model.forward(x, bag, first)
    loss = -(weight * np.log(np.where(y == 1, p, 1 - p))).sum()
    d = ((p - y) * weight).astype(x.dtype)
    dz = d[:, None] * wo
    da = (dz[bag] * h).sum(1)
    dl = a * (da - np.add.reduceat(a * da, first)[bag])
    gate = dl[:, None] * w
    dv, du = gate * su * (1 - tv * tv), gate * tv * su * (1 - su)
    dh = a[:, None] * dz[bag] + dv @ v.T + du @ u.T
    dx = dh * (1 - h * h)
    return float(loss), [x.T @ dx, dx.sum(0), h.T @ dv, h.T @ du, (tv * su).T @ dl, z.T @ d, d.sum(keepdims=True)]


def train(sample: list[tuple[str, int]], epochs: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Model:
    """A model from (text, label) pairs."""
    y = np.array([label for _, label in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), [])
    encode = Encoder().passages
    features = [encode(t) for t, _ in sample]
    sizes = np.array([len(f) for f in features])
    bag, first = np.repeat(np.arange(len(y)), sizes), np.cumsum(np.r_[0, sizes[:-1]])
    x = np.concatenate(features)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = [draw(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32)]
    model = Model(mean, scale, weights)
    m, s = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for epoch in range(1, epochs + 1):
        grads = gradients(model, x, bag, first, y, weight)[1]
        for k, (q, g) in enumerate(zip(weights, grads)):
            g = g + decay * q
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            q -= (rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(s[k] / (1 - 0.99**epoch)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """A model from at most `per_class[y]` labelled documents of each class y."""
    return train(labelled_sample(docs, labels, label, per_class))


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score; the model is a few KB."""

    def scores():
        encode = Encoder().passages

        def of(texts: list[str | None]) -> list[float]:
            found, held, rows = [], [], 0
            for t in texts:
                held.append(encode(t))
                rows += len(held[-1])
                if rows > 1 << 16:
                    found.append(model.scores(held))
                    held, rows = [], 0
            found.append(model.scores(held))
            return np.concatenate(found).tolist()

        return of

    return score_column(scores)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scorer(docs, model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` without the rows that score below `threshold`; all columns are kept."""
    name = free_name(docs, "quality")
    out = docs.withColumn(name, scorer(docs, model)(F.col(text_col)))
    return out.where(F.col(name) >= threshold).select(*[out[c] for c in docs.columns])
