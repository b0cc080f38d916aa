"""Toxicity scores from subword bags under one linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (hashed into a fixed
number of buckets, edges marked), a window's vector is the mean over its word slots (empty
slots of a short text, and words met again within a window's length, count as zero, so
stuttering cannot shout), and a linear softmax reads it. Buckets and softmax are trained together, so a misspelling that was never
seen shares most of its n-gram vectors with the word it hides. A document is scored over
all its windows; its score is that of the window likeliest to be toxic, so one insult in a
very long text is not averaged away.

Training first gives each window its document's label, then goes over to the likeliest
window of each document. The sample is bounded by `Sample` (documents a class, characters a
training document), scoring is not: every whole text counts.

Defined results: null and empty texts hold no word and get the softmax of the bias alone;
labels other than 0 and 1 are not learnt from, of several labels of a document the largest
counts, and of several texts the smallest; with one class or none the score is that class's smoothed share (0.5 without any
label). Rows without an id are never learnt from. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, texts_of

_WORD = re.compile(r"\w+")
BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4, 5)
WINDOW, STRIDE = 32, 16
MEMO_WORDS = 1_000_000


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learnt from: documents of each class and characters of each."""

    per_class: int = 3000
    max_chars: int = 12_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every n-gram of the edge-marked words, word after word, and where each begins.

    Every word has at least one n-gram, for its marked form has three characters or more.
    """
    marked = "".join(f"<{w}>" for w in words)
    x = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), length)
    found, owners = [], []
    for n in SIZES:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ x[j : len(x) - n + 1 + j]
            h ^= h >> np.uint64(29)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append((h[inside] % BUCKETS).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    buckets, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return buckets[order], starts


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping [start, end) windows over n words; one for a short text, none without words."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    return [(i, min(n, i + WINDOW)) for i in range(0, n - WINDOW + STRIDE, STRIDE)]


def echoes(ids: np.ndarray) -> np.ndarray:
    """Positions whose word stood less than a window's length before."""
    order = np.argsort(ids, kind="stable")
    again = (np.diff(ids[order]) == 0) & (np.diff(order) < WINDOW)
    return order[1:][again]


@dataclass
class Model:
    """Bucket vectors, softmax weights (two columns) and biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @cached_property
    def bucket_logits(self) -> np.ndarray:
        """Each bucket's part of the logit difference."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def word_logits(self, words: list[str]) -> np.ndarray:
        """Each word's part of a window's logit difference; linear, so windows average it."""
        if not words:
            return np.empty(0)
        buckets, starts = subwords(words)
        part = self.bucket_logits[buckets]
        return np.add.reduceat(part, starts) / np.diff(np.append(starts, len(buckets)))


def _segment_sum(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(to, values[:, d], n) for d in range(values.shape[1])], axis=1)


class _Trainer:
    def __init__(self, texts: list[str], labels: list[int], seed: int):
        ids: dict[str, int] = {}
        docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
        self.buckets, starts = subwords(list(ids))
        self.ngram_at = np.append(starts, len(self.buckets))
        spans = [(d, a, b) for d, x in enumerate(docs) for a, b in windows_of(len(x))]
        once = [np.ones(len(x), bool) for x in docs]
        for x, keep in zip(docs, once):
            keep[echoes(x)] = False
        self.words = [docs[d][a:b][once[d][a:b]] for d, a, b in spans]
        self.doc = np.array([d for d, _, _ in spans])
        self.label = np.array(labels)[self.doc]
        self.rng = np.random.default_rng(seed)
        self.m = Model(self.rng.normal(0, 0.1, (BUCKETS, DIM)), self.rng.normal(0, 0.5, (DIM, 2)), np.zeros(2))
        self.sq = [np.full_like(x, 1e-3) for x in (self.m.vectors, self.m.weights, self.m.bias)]

    def step(self, rows: np.ndarray, rate: float) -> None:
        """One Adagrad step on these windows."""
        m = self.m
        words = np.concatenate([self.words[i] for i in rows])
        lens = np.array([len(self.words[i]) for i in rows])
        win = np.repeat(np.arange(len(rows)), lens)
        vocab, inv = np.unique(words, return_inverse=True)
        a, n = self.ngram_at[vocab], self.ngram_at[vocab + 1] - self.ngram_at[vocab]
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        buckets, inv_b = np.unique(self.buckets[at], return_inverse=True)
        owner = np.repeat(np.arange(len(vocab)), n)
        word_vec = _segment_sum(m.vectors[buckets][inv_b], owner, len(vocab)) / n[:, None]
        hidden = _segment_sum(word_vec[inv], win, len(rows)) / WINDOW
        z = hidden @ m.weights + m.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), self.label[rows]] -= 1
        dz = p / len(rows)
        d_hidden = dz @ m.weights.T
        d_word = _segment_sum((d_hidden / WINDOW)[win], inv, len(vocab))
        d_vec = _segment_sum((d_word / n[:, None])[owner], inv_b, len(buckets))
        for x, g, s, at_rows in ((m.weights, hidden.T @ dz, self.sq[1], slice(None)), (m.bias, dz.sum(0), self.sq[2], slice(None)), (m.vectors, d_vec * len(rows) ** 0.5, self.sq[0], buckets)):
            s[at_rows] += g * g
            x[at_rows] -= rate * g / np.sqrt(s[at_rows])

    def run(self, first: int, then: int) -> Model:
        """`first` epochs on all windows, then `then` epochs on each document's likeliest window.

        Batches shrink with the sample, so that a small one takes enough steps.
        """
        pos, neg = np.flatnonzero(self.label == 1), np.flatnonzero(self.label == 0)
        for _ in range(first):
            some = self.rng.choice(neg, min(len(neg), len(pos)), replace=False)
            order = self.rng.permutation(np.concatenate([pos, some]))
            batch = max(16, min(512, len(order) // 24))
            for i in range(0, len(order), batch):
                self.step(order[i : i + batch], 0.3)
        vocab_part = np.repeat(np.arange(len(self.ngram_at) - 1), np.diff(self.ngram_at))
        flat = np.concatenate(self.words)
        win = np.repeat(np.arange(len(self.words)), [len(x) for x in self.words])
        for _ in range(then):
            side = (self.m.vectors @ (self.m.weights[:, 1] - self.m.weights[:, 0]))[self.buckets]  # not the cached one
            word = np.bincount(vocab_part, side) / np.diff(self.ngram_at)
            logit = np.bincount(win, word[flat], len(self.words))
            best = np.lexsort((-logit, self.doc))
            top = best[np.append(True, np.diff(self.doc[best]) > 0)]
            order = self.rng.permutation(top)
            batch = max(16, min(512, len(order) // 12))
            for i in range(0, len(order), batch):
                self.step(order[i : i + batch], 0.2)
        return self.m


def fit(texts: list[str], labels: list[int], *, seed: int = 7, first: int = 2, then: int = 20) -> Model:
    """The jointly trained model; a constant one unless both classes hold words."""
    kept = [(t, y) for t, y in zip(texts, labels) if _WORD.search(t)]
    if len({y for _, y in kept}) == 2:
        return _Trainer([t for t, _ in kept], [y for _, y in kept], seed).run(first, then)
    n, toxic = len(labels), sum(labels)
    share = (toxic + 0.5) / (n + 1)
    return Model(np.zeros((BUCKETS, DIM)), np.zeros((DIM, 2)), np.array([0.0, float(np.log(share / (1 - share)))]))


def document_logit(ids: np.ndarray, values: np.ndarray) -> float:
    """The likeliest window's mean, for a document of these word ids and each word's logit."""
    part = values[ids]
    part[echoes(ids)] = 0.0
    sums = np.append(0.0, np.cumsum(part))
    spans = np.array(windows_of(len(ids)) or [(0, 0)])
    return float((sums[spans[:, 1]] - sums[spans[:, 0]]).max()) / WINDOW


def held_out(id_col: str) -> Column:
    """True where crc32 of the id's text is divisible by five, and where there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: Sample, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label): the sample's rows, those of the smallest id hash in each class."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    usable = usable.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    texts = texts_of(docs, id_col, text_col).withColumnRenamed(id_col, "id").where(F.length("text") <= sample.max_chars)
    chosen = None
    for y in (0, 1):
        one = usable.where(F.col("label") == y).orderBy(F.xxhash64(F.col("id")), "id").limit(sample.per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    # at most 2 * per_class rows of an id and a label: bounded by the parameter
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: Sample = Sample()) -> Model:
    """fit() on the bounded sample, on the driver."""
    rows = sorted(training_rows(docs, labels, sample, id_col=id_col, text_col=text_col, label_col=label_col).collect())
    return fit([r.text for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, n_words long) of every whole text; only the text is read for it."""
    texts = texts_of(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    schema = T.StructType([texts.schema[0], T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def make():
        memo: dict[str, int] = {}
        values = np.empty(0)
        m = sent.value
        base = float(m.bias[1] - m.bias[0])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs_words = [words_of(t) for t in batch.column(1).to_pylist()]
            nonlocal values
            if len(memo) > MEMO_WORDS:
                memo.clear()
                values = np.empty(0)
            new = list({w for ws in docs_words for w in ws if w not in memo})
            memo.update(zip(new, range(len(memo), len(memo) + len(new))))
            values = np.concatenate([values, *(m.word_logits(new[i : i + 50_000]) for i in range(0, len(new), 50_000))])
            logits = [document_logit(np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws)), values) + base for ws in docs_words]
            out = 1 / (1 + np.exp(-np.clip(np.array(logits), -500, 500)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array([len(x) for x in docs_words], pa.int64())], names=[batch.schema.names[0], "score", "n_words"])

        return step

    return map_arrow(texts, make, schema)
