"""Operator 10: toxicity by averaged subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (and itself) in hashed buckets; its vector is
their mean. A passage is the mean of its words' vectors, a linear softmax over it gives its
class, and a document is as toxic as its most toxic passage, so that length
does not dilute a few words. Embeddings and softmax are trained together in numpy by
Adam on the passages that decide. An unseen
misspelling shares most n-grams with what it misspells.

Scoring is linear in the words, so a word's share is computed once and remembered.

Defined cases: a text without words scores as the bias alone; null counts as empty; without labels
of both classes every score is 0; texts of any length are scored whole; a score equal to the threshold is
toxic; of equally toxic passages the first teaches; repeated rows score alike; a null doc_id stays null
and is not held out; an empty table gives an empty result; columns of any other name are kept by
`keep_clean` and not read by `classify`. A run of more than LONGEST characters without white
space (joined terms, a script without spaces) counts as several words, see `parts_of`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out, labelled_sample, score_column

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 7)
#: Words of a passage, and from one passage's start to the next.
PASSAGE, STRIDE = 3, 1
#: Labelled documents of class 0 and 1 that the model is fitted on, at most.
PER_CLASS = (1600, 800)
#: Labelled documents that a bucket must be in to have a vector.
LEAST_DOCS = 4
REMEMBERED = 250_000
#: Characters of a run that is one word, and of the texts that are scored together.
LONGEST, TOGETHER = 40, 2_000_000
#: Words of the sample's texts that the training looks for deciding passages in at a time, about.
TRAINED = 1 << 18
#: Characters from one piece of a longer run to the next, and of a piece: each n-gram is in one.
STEP = 6
PIECE = STEP + GRAMS[1] - 1
PRIME, MIX, BASE = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
STRIP = "\"'`.,;:!?()[]{}<>#*$%&|~^_=+-/\\@"
INNER = re.compile(f"[{re.escape(STRIP)}]+")


def words_of(text: str | None) -> list[str]:
    """The runs of a text between white space, long ones in parts."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[str] = []
    for w in words:
        if len(w) > LONGEST and len(core := core_of(w)) > LONGEST:
            out += parts_of(core)
        else:
            out.append(w)
    return out


def parts_of(run: str) -> list[str]:
    """A long run as words: pieces that overlap by the longest n-gram less 1, so that no part
    of it is left out, and then what stands between the signs inside it."""
    pieces = [run[k : k + PIECE] for k in range(0, len(run) - GRAMS[1] + 1, STEP)]
    return pieces + [w for w in INNER.split(run) if 0 < len(w) <= LONGEST]


def core_of(word: str) -> str:
    """A word without the signs around it."""
    return word.strip(STRIP) or word


def grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, bucket) of each word itself and of its n-grams, with marks at
    both ends, by polynomial hashes over code points. A word of signs alone has itself."""
    marked = [f"<{core_of(w)}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(marked)), size)
    room = np.repeat(stop, size) - np.arange(len(code))
    place = np.arange(len(code)) - np.repeat(stop - size, size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(size.max(initial=0), BASE, np.uint64))
        whole = np.add.reduceat((code + np.uint64(1)) * powers[place], stop - size)
        owners, hashes = [np.arange(len(marked))], [whole]
        h = code.copy()
        for n in range(2, GRAMS[1] + 1):
            h[: len(h) - n + 1] = h[: len(h) - n + 1] * PRIME + code[n - 1 :]
            if n >= GRAMS[0]:
                fits = room >= n
                owners.append(owner[fits])
                hashes.append(h[fits] * np.uint64(n + 1))
        every = np.concatenate(hashes) * MIX
    return np.concatenate(owners), (every >> np.uint64(48)).astype(np.int32) % BUCKETS


def passages(n: int) -> np.ndarray:
    """First words of the passages over n words; the last ends with the text."""
    if n <= PASSAGE:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - PASSAGE, STRIDE)
    return np.r_[starts, n - PASSAGE]


class Adam:
    def __init__(self, shapes: Sequence[np.ndarray], rate: float):
        self.m = [np.zeros_like(s) for s in shapes]
        self.v = [np.zeros_like(s) for s in shapes]
        self.rate, self.t = rate, 0

    def step(self, values: Sequence[np.ndarray], grads: Sequence[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(values, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


@dataclass
class Model:
    """bucket: what a bucket adds to the log odds of a word that is it alone."""

    bucket: np.ndarray
    bias: float

    def __post_init__(self):
        #: shares of words as they stand, and of words without signs around them
        self.known: dict[str, float] = {}
        self.cores: dict[str, float] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Remember the shares of words."""
        known, cores = self.known, self.cores
        if len(cores) > REMEMBERED:
            cores.clear()
        pairs = [(w, core_of(w)) for w in words]
        new = list({c for _, c in pairs}.difference(cores))
        for k in range(0, len(new), 1 << 15):
            some = new[k : k + (1 << 15)]
            owner, bucket = grams(some)
            total = np.bincount(owner, self.bucket[bucket], len(some))
            cores.update(zip(some, (total / np.bincount(owner, minlength=len(some))).tolist()))
        for w, c in pairs:
            known[w] = cores[c]

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Probability of the most toxic passage of each text."""
        out: list[float] = []
        held: list[list[str]] = []
        chars = 0
        for t in texts:
            held.append(words_of(t))
            chars += len(t or "")
            if chars > TOGETHER:
                out += self._scores(held)
                held, chars = [], 0
        return out + self._scores(held)

    def _scores(self, texts: list[list[str]]) -> list[float]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new: set[str] = set()
        for words in texts:
            new.update(set(words).difference(known))
        self.learn(new)
        out = []
        for words in texts:
            if words:
                each = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                total = np.r_[0.0, np.cumsum(each)]
                first = passages(len(words))
                last = np.minimum(first + PASSAGE, len(words))
                top = ((total[last] - total[first]) / (last - first)).max() + self.bias
            else:
                top = self.bias
            out.append(float(1 / (1 + np.exp(-np.clip(top, -60, 60)))))
        return out


class Bags:
    """The buckets of numbered words, as one run of numbers and where each word's begin."""

    def __init__(self, words: list[str]):
        sizes, buckets = [], []
        for k in range(0, len(words), 1 << 14):
            owner, bucket = grams(words[k : k + (1 << 14)])
            sizes.append(np.bincount(owner))
            buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.min_scalar_type(BUCKETS - 1)))
        self.size, self.bucket = np.concatenate(sizes), np.concatenate(buckets)
        self.first = np.cumsum(self.size) - self.size

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `words`, bucket) of each bucket of these words."""
        n = self.size[words]
        owner = np.repeat(np.arange(len(words)), n)
        return owner, self.bucket[np.arange(len(owner)) + np.repeat(self.first[words] - np.cumsum(n) + n, n)]

    def means(self, value: np.ndarray) -> np.ndarray:
        """Mean value over the buckets of each word."""
        out = np.empty(len(self.size), np.float32)
        for k in range(0, len(out), 1 << 15):
            size, first = self.size[k : k + (1 << 15)], self.first[k : k + (1 << 15)]
            part = value[self.bucket[first[0] : first[-1] + size[-1]]]
            out[k : k + (1 << 15)] = np.add.reduceat(part, first - first[0]) / size
        return out


def gradients(e: np.ndarray, w: np.ndarray, b: np.ndarray, bags: Bags, words: np.ndarray, doc: np.ndarray, size: np.ndarray, classes: np.ndarray, weight: np.ndarray) -> tuple:
    """The weighted log loss of documents, and its gradients by embeddings, softmax and bias.
    The deciding passage of document i has `size[i]` words, those of `words` where `doc` is i."""
    owner, bucket = bags.of(words)
    share = (1 / (bags.size[words][owner] * size[doc][owner])).astype(e.dtype)
    x = np.stack([np.bincount(doc[owner], e[bucket, k] * share, len(size)) for k in range(e.shape[1])], 1).astype(e.dtype)
    logits = x @ w + b
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -(weight * classes * np.log(np.maximum(p, 1e-30))).sum()
    d = (p - classes) * weight
    gx = (d @ w.T)[doc[owner]] * share[:, None]
    ge = np.stack([np.bincount(bucket, gx[:, k], len(e)) for k in range(e.shape[1])], 1).astype(e.dtype)
    return float(loss), ge, x.T @ d, d.sum(0)


def deciding(each: np.ndarray, tokens: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, lead) of the first most toxic passage of each text, from the shares of the words. Text i has
    the words `tokens[offset[i] : offset[i + 1]]`; an empty one has an empty passage that leads by 0. Texts of some
    TRAINED words are looked at together, so that what is held besides does not grow with the sample."""
    start, stop = np.empty((2, len(offset) - 1), np.int64)
    lead = np.empty(len(start))
    carry, i = 0.0, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + TRAINED, "right")) - 1)
        a, b = offset[i], offset[j]
        total = np.cumsum(np.r_[carry, each[tokens[a:b]]], dtype=np.float64)
        carry = total[-1]
        inside = [passages(n) for n in np.diff(offset[i : j + 1])]
        many = np.array([len(x) for x in inside])
        first = np.cumsum(many) - many
        begin = np.concatenate(inside) + np.repeat(offset[i:j] - a, many)
        end = np.minimum(begin + PASSAGE, np.repeat(offset[i + 1 : j + 1] - a, many))
        leads = (total[end] - total[begin]) / np.maximum(1, end - begin)
        lead[i:j] = np.maximum.reduceat(leads, first)
        top = np.flatnonzero(leads == np.repeat(lead[i:j], many))
        top = top[np.searchsorted(top, first)]
        start[i:j], stop[i:j] = begin[top] + a, end[top] + a
        i = j
    return start, stop, lead


def train(sample: list[tuple[str, int]], epochs: int = 80, rate: float = 0.1, decay: float = 1e-3, seed: int = 5) -> Model:
    """Embeddings and softmax from (text, label) pairs.

    The first coordinate of a bucket starts at the log odds of its documents between
    the classes, the others at random; buckets in fewer than LEAST_DOCS documents stay 0.
    Which passage decides is found from sums per word; vectors are made for the
    words of the deciding passages alone.
    """
    labels = np.array([y for _, y in sample], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), -60.0)
    number: dict[str, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t, _ in sample]
    if not number:
        return Model(np.zeros(BUCKETS), -60.0)
    bags = Bags(list(number))
    inside = np.zeros((2, BUCKETS))
    for t, y in zip(texts, labels):
        if len(t):
            inside[int(y), np.unique(bags.of(np.unique(t))[1])] += 1
    used = inside.sum(0) >= LEAST_DOCS
    n = np.bincount(labels.astype(int), minlength=2)
    rates = (inside + 2) / (n[:, None] + 4)
    rng = np.random.default_rng(seed)
    e = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    e[:, 0] = np.log(rates[1] / rates[0])
    e[~used] = 0
    w = np.zeros((DIM, 2), np.float32)
    w[0] = -1, 1
    w[1:] = (rng.random((DIM - 1, 2), np.float32) - 0.5) / DIM
    b = np.zeros(2, np.float32)
    adam = Adam((e, w, b), rate)
    offset = np.cumsum([0, *map(len, texts)])
    tokens = np.concatenate(texts)
    del texts
    classes = np.stack([1 - labels, labels], 1)
    weight = np.where(labels == 1, 0.4 / labels.mean(), 0.6 / (1 - labels.mean())).astype(np.float32)[:, None] / len(labels)
    for epoch in range(epochs):
        each = bags.means(e @ (w[:, 1] - w[:, 0]))
        start, stop, best = deciding(each, tokens, offset)
        if not epoch:  # begin between the classes' deciding passages
            b[1] = -(np.median(best[labels == 1]) + np.median(best[labels == 0])) / 2
        many = stop - start
        doc = np.repeat(np.arange(len(labels)), many)
        words = tokens[np.arange(len(doc)) + np.repeat(start - np.cumsum(many) + many, many)]
        _, ge, gw, gb = gradients(e, w, b, bags, words, doc, np.maximum(1, many), classes, weight)
        ge += decay * e / used.sum()
        ge[~used] = 0
        adam.step((e, w, b), (ge, gw, gb))
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """A model from at most `per_class[y]` labelled documents of each class y."""
    return train(labelled_sample(docs, labels, label, per_class))


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score. The model is 256 KB, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket, model.bias))

    return score_column(lambda: Model(*shared.value).scores)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scorer(docs, model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score as toxic; all columns are kept."""
    name = free_name(docs, "toxicity")
    out = docs.withColumn(name, scorer(docs, model)(F.col(text_col)))
    return out.where(F.col(name) < threshold).select(*[out[c] for c in docs.columns])
