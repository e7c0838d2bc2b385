"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, its ends marked, and of itself; a text is the mean of the embeddings of all its
n-grams and words. Embeddings and softmax are trained together. An unseen misspelling shares most n-grams with the words that
it comes from. After training the class scores of the mean are the mean of class scores, so scoring needs a number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.llm import labelled
from textweft.llm import textkernel as tk
from textweft.plans.tables import written

#: The score from which a document counts as toxic.
THRESHOLD = 0.3
GRAMS = (3, 4, 5)
BITS, WIDTH = 17, 8
#: Bounds of the training sample: documents, and distinct (document, bucket) pairs.
TRAIN_DOCS, TRAIN_PAIRS = 6000, 16_000_000
EPOCHS, BATCH, RATE = 10, 64, 0.05
#: Buckets that fewer training documents have get no embedding: they'd learn single documents by heart.
LEAST_DOCS = 3
#: The mean is multiplied by this, so that one word in a hundred moves it.
GAIN = 64.0
#: A text's mean also counts so many n-grams of no meaning, so that a few of a very short text don't decide it.
PADDING = 60

_MARK = 1
_ODD = [tk.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def buckets(texts: pa.Array) -> _Bag | None:
    """The buckets of the n-grams of each word, case folded; none without a word. ``texts`` has no nulls."""
    lowered = pc.utf8_lower(texts)
    w = tk.words(lowered, fold=False)
    if not len(w.hash):
        return None
    # each word once per slice: its code points between marks
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    starts, ends = w.start[first], w.end[first]
    size = ends - starts
    at = np.cumsum(size) - size
    source = np.arange(size.sum()) - np.repeat(at, size) + np.repeat(starts, size)
    points, point_word = _code_points(w.data[source], np.repeat(np.arange(len(first)), size))
    n_points = np.bincount(point_word, minlength=len(first))
    padded = np.full(len(points) + 2 * len(first), _MARK, np.uint64)
    place = np.arange(len(points)) + 2 * point_word + 1
    padded[place] = points
    owner = np.repeat(np.arange(len(first)), n_points + 2)
    found, whose = [(w.hash[first] >> tk.U(64 - BITS)).astype(np.int64)], [np.arange(len(first))]
    for n in GRAMS:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        total = np.zeros(m, tk.U)
        for i in range(n):
            total += padded[i : i + m] * _ODD[i]
        inside = np.flatnonzero(owner[:m] == owner[n - 1 :])
        found.append((tk.mix(total[inside], n) >> tk.U(64 - BITS)).astype(np.int64))
        whose.append(owner[inside])
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return _Bag(found[order], np.searchsorted(whose[order], np.arange(len(first) + 1)), inverse, w.row)


class _Bag(NamedTuple):
    """Buckets of each distinct word (``found[cut[i]:cut[i + 1]]``), the distinct word and the row of each word."""

    found: np.ndarray
    cut: np.ndarray
    word: np.ndarray
    row: np.ndarray


def _code_points(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point of UTF-8 bytes, equal for equal code points, and its owner."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        return data.astype(np.uint64), owner
    size = np.diff(np.append(lead, len(data)))
    value = data[lead].astype(np.uint64)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        value[more] = (value[more] << np.uint64(8)) | data[lead[more] + i]
    return value, owner[lead]


class Model(NamedTuple):
    """A score for each bucket, class 1 minus class 0; ``constant`` is the score of all texts where the sample had not both labels."""

    bucket: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        n = len(texts)
        bag = buckets(texts)
        logit = np.full(n, self.bias)
        if bag is not None:
            sums = np.add.reduceat(self.bucket[bag.found].astype(np.float64), bag.cut[:-1])
            sizes = np.diff(bag.cut)
            total = np.bincount(bag.row, sums[bag.word], n)
            count = np.bincount(bag.row, sizes[bag.word], n)
            logit += GAIN * total / (count + PADDING)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def pairs(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct buckets and their shares."""
    bag = buckets(texts)
    none = (np.zeros(0, np.int32), np.zeros(0, np.float32))
    if bag is None:
        return [none] * len(texts)
    out = []
    cut = np.searchsorted(bag.row, np.arange(len(texts) + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        word, times = np.unique(bag.word[a:b], return_counts=True)
        sizes = np.diff(bag.cut)[word]
        if not sizes.sum():
            out.append(none)
            continue
        at = np.cumsum(sizes) - sizes
        source = np.arange(sizes.sum()) - np.repeat(at, sizes) + np.repeat(bag.cut[word], sizes)
        sums = np.bincount(bag.found[source], np.repeat(times, sizes), 1 << BITS)
        have = np.flatnonzero(sums)
        out.append((have.astype(np.int32), (sums[have] / (sums.sum() + PADDING)).astype(np.float32)))
    return out


def fit_pairs(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> Model:
    """Trains embeddings and softmax together, by Adagrad on minibatches."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        return Model(np.zeros(0), 0.0, float((y.sum() + 1) / (n + 2)))
    seen = np.bincount(np.concatenate([r[0] for r in rows]), minlength=1 << BITS) >= LEAST_DOCS
    rows = [(ids[seen[ids]], share[seen[ids]]) for ids, share in rows]
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (1 << BITS, WIDTH)).astype(np.float32) * seen[:, None]
    softmax = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_table, g_softmax, g_bias = np.full(1 << BITS, 1e-6, np.float32), np.full_like(softmax, 1e-6), np.full_like(bias, 1e-6)
    goal = np.eye(2, dtype=np.float32)[y.astype(int)]
    for _ in range(max(EPOCHS, min(100, -(-300 * BATCH // n)))):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            some = order[lo : lo + BATCH]
            ids = np.concatenate([rows[i][0] for i in some])
            share = np.concatenate([rows[i][1] for i in some]) * np.float32(GAIN)
            sizes = np.array([len(rows[i][0]) for i in some])
            who = np.repeat(np.arange(len(some)), sizes)
            used, local = np.unique(ids, return_inverse=True)
            mean = np.zeros((len(some), WIDTH), np.float32)
            vectors = table[used]
            for k in range(WIDTH):
                mean[:, k] = np.bincount(who, vectors[local, k] * share, len(some))
            logits = mean @ softmax + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            d = (p - goal[some]) / len(some)
            dmean = d @ softmax.T
            dsoft, dbias = mean.T @ d, d.sum(0)
            grad = np.stack([np.bincount(local, dmean[who, k] * share, len(used)) for k in range(WIDTH)], 1).astype(np.float32)
            g_table[used] += (grad * grad).mean(1)
            table[used] -= RATE * grad / np.sqrt(g_table[used])[:, None]
            g_softmax += dsoft * dsoft
            softmax -= RATE * dsoft / np.sqrt(g_softmax)
            g_bias += dbias * dbias
            bias -= RATE * dbias / np.sqrt(g_bias)
    difference = softmax[:, 1] - softmax[:, 0]
    return Model((table @ difference).astype(np.float32), float(bias[1] - bias[0]))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in tk.slices(batch["text"]):
            part = batch.slice(at, len(texts))
            both = pairs(texts)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array([a.tobytes() for a, _ in both], pa.binary()), pa.array([b.tobytes() for _, b in both], pa.binary())], ["doc_id", "label", "id", "share"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_pairs: int = TRAIN_PAIRS) -> Model:
    """Learns from at most ``train_docs`` labelled documents that aren't held out, as far as ``train_pairs`` reaches; whole texts.

    Where that is short of all of them, the first in a random but fixed order count.
    """
    tk.small_batches(docs.sparkSession)
    few = labelled.sample(docs, labels, "toxic", train_docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = few.mapInArrow(_training, f"doc_id {id_type}, label int, id binary, share binary")
    # a scan of all documents finds few rows: in a few files they are read at once
    table = written(made.withColumn("place", F.xxhash64("doc_id")).repartition(16), "training")
    # by partition, of which there are 16 at most, so the JVM holds one at a time
    rows = labelled.within(table, F.octet_length("id") / 4, train_pairs).toLocalIterator()
    found = [(r["place"], r["doc_id"], bytes(r["id"]), r["label"], np.frombuffer(r["share"], np.float32)) for r in rows]
    found.sort(key=lambda x: x[:3])
    return fit_pairs([(np.frombuffer(x[2], np.int32), x[4]) for x in found], np.array([x[3] for x in found], np.float32))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has the score of the softmax's bias alone. Rows without a doc_id count as not held out. Repeated rows have
    equal scores. Labels that are null, other than 0 and 1 or contradictory aren't used; without both labels every score is the
    smoothed share of label 1. Empty documents give an empty table.
    """
    return labelled.results(docs, fit(docs, labels, **options).score, THRESHOLD)
