"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Each passage is encoded from character statistics, repetition and hashed words by a tanh
layer; a gated attention network weighs the encodings of a bag, and a logistic unit scores the weighted sum. All weights are
learned together, from labels of whole documents. Only the text goes in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.llm import labelled
from textweft.llm import textkernel as tk
from textweft.plans.tables import written

PASSAGE_WORDS = 64
HASHED = 32
#: The score from which a document counts as good.
THRESHOLD = 0.7
#: Bounds of the training sample: labelled documents, and passages of all of them together. Every document counts whole.
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 400_000
EPOCHS, BAGS, RATE = 30, 128, 0.01

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:?'\"()-", b"!", b"\n", b" \t\r"]
_CLASS = np.full(256, len(_CLASSES) + 1, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_CLASSES)
_N_CLASSES = len(_CLASSES) + 2
WIDTH = _N_CLASSES + 8 + HASHED


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features ``(passages, WIDTH)`` and the row of each passage; a row has one at least. ``texts`` has no nulls."""
    w = tk.words(texts, fold=False)
    n_rows = len(texts)
    counts = np.diff(w.first)
    of_row = np.maximum(1, -(-counts // PASSAGE_WORDS))
    row = np.repeat(np.arange(n_rows), of_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(of_row) - of_row, of_row)
    first = w.first[row] + nth * PASSAGE_WORDS
    n = np.minimum(PASSAGE_WORDS, w.first[row + 1] - first)
    _, off = tk.raw(texts)
    begin = off[row].copy()
    later = nth > 0
    begin[later] = w.start[first[later]]
    size = np.diff(np.append(begin, len(w.data)))
    x = np.zeros((len(row), WIDTH), np.float32)
    some = np.flatnonzero(size)
    if len(some):
        kinds = _CLASS[w.data]
        for c in range(_N_CLASSES):
            x[some, c] = np.add.reduceat((kinds == c).view(np.uint8), begin[some], dtype=np.int32)
        x[:, :_N_CLASSES] /= np.maximum(size, 1)[:, None]
    passage = np.repeat(np.arange(len(row)), n)
    c = _N_CLASSES
    words = np.maximum(n, 1)
    x[:, c] = np.log1p(n)
    x[:, c + 1] = np.log1p(size / words)
    if len(passage):
        length = w.end - w.start
        total = lambda v: np.bincount(passage, v, len(row)) / words
        x[:, c + 2] = total(length <= 3)
        x[:, c + 3] = total(length >= 14)
        same = np.zeros(len(passage), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1])
        x[:, c + 4] = total(same)
        key = np.sort((passage.astype(tk.U) << tk.U(40)) | (w.hash >> tk.U(24)))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        x[:, c + 5] = np.bincount((key[fresh] >> tk.U(40)).astype(np.int64), minlength=len(row)) / words
        initial = w.data[w.start]
        x[:, c + 6] = total((initial >= 65) & (initial <= 90))
        gap = np.zeros(len(passage))
        gap[:-1] = w.start[1:] - w.end[:-1]
        x[:, c + 7] = total(np.clip(gap, 0, 8))
        slot = passage * HASHED + (w.hash & tk.U(HASHED - 1)).astype(np.int64)
        x[:, c + 8 :] = np.bincount(slot, minlength=len(row) * HASHED).reshape(-1, HASHED) / np.sqrt(words)[:, None]
    return x, row


class Model(NamedTuple):
    """Weights; ``constant`` is the score of every text where the sample had not both labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def attention(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The attention weight of each passage within its bag, and the score of each bag. ``row`` is in order, without gaps."""
        state = _forward((x - self.mean) / self.scale, np.flatnonzero(np.diff(row, prepend=-1)), row, self.weights)
        return state["a"], state["p"]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.attention(*passages(texts))[1].astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, at: np.ndarray, row: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(np.clip(x, -8, 8) @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, at)[row])
    a = e / np.add.reduceat(e, at)[row]
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ p["c"] + p["d"])}


def _gradients(x: np.ndarray, at: np.ndarray, row: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    s = _forward(x, at, row, p)
    dlogit = (s["p"] - y) / len(y)
    dz = dlogit[:, None] * p["c"][None, :]
    per = (dz[row] * s["h"]).sum(1)
    de = s["a"] * (per - np.add.reduceat(s["a"] * per, at)[row])
    gated = de[:, None] * p["w"][None, :]
    dt, dg = gated * s["g"] * (1 - s["t"] ** 2), gated * s["t"] * s["g"] * (1 - s["g"])
    dh = (s["a"][:, None] * dz[row] + dt @ p["V"].T + dg @ p["U"].T) * (1 - s["h"] ** 2)
    return {"c": s["z"].T @ dlogit, "d": dlogit.sum(keepdims=True), "w": (s["t"] * s["g"]).T @ de, "V": s["h"].T @ dt, "U": s["h"].T @ dg, "W": np.clip(x, -8, 8).T @ dh, "b": dh.sum(0)}


def fit_bags(x: np.ndarray, row: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Learns from bags: ``row`` numbers the bags in order, ``y`` has a label for each."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float((y.sum() + 1) / (n + 2)))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    shapes = {"W": (WIDTH, 24), "b": (24,), "V": (24, 12), "U": (24, 12), "w": (12,), "c": (24,), "d": (1,)}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b", "d") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    first = np.searchsorted(row, np.arange(n + 1))
    step = 0
    for _ in range(max(EPOCHS, -(-600 * BAGS // n) if n < 2500 else 0)):
        order = rng.permutation(n)
        for lo in range(0, n, BAGS):
            bags = order[lo : lo + BAGS]
            sizes = np.diff(first)[bags]
            who = np.repeat(np.arange(len(bags)), sizes)
            at = np.cumsum(sizes) - sizes
            pick = np.arange(sizes.sum()) - at[who] + first[bags][who]
            step += 1
            for k, g in _gradients(x[pick], at, who, y[bags], p).items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean.astype(np.float32), scale.astype(np.float32), p)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in tk.slices(batch["text"]):
            x, row = passages(texts)
            cut = np.searchsorted(row, np.arange(len(texts) + 1))
            part = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> Model:
    """Learns from all passages of at most ``train_docs`` labelled documents that aren't held out.

    Documents that would bring all passages above ``train_passages`` aren't used, the last in a random but fixed order first.
    """
    tk.small_batches(docs.sparkSession)
    few = labelled.sample(docs, labels, "quality", train_docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = few.mapInArrow(_bags, f"doc_id {id_type}, label int, x binary").withColumn("place", F.xxhash64("doc_id"))
    table = written(made, "training")
    rows = list(labelled.within(table, F.octet_length("x") / (4 * WIDTH), train_passages).toLocalIterator())
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32)
    return fit_bags(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r["label"] for r in rows], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text, ...)``.

    A null or empty text is one empty passage and has a score like any other. Rows without a doc_id count as not held out.
    Repeated rows have equal scores. Labels that are null, other than 0 and 1 or contradictory aren't used; without both labels
    every score is the smoothed share of label 1. Empty documents give an empty table.
    """
    return labelled.results(docs, fit(docs, labels, **options).score, THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``THRESHOLD``."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return labelled.scored(docs, fit(docs, labels, **options).score, name).filter(f"`{name}` >= {THRESHOLD}").drop(name)
