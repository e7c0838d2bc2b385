"""Fingerprints: k-gram hashes of a token sequence, sampled by winnowing.

A sequence never spans rows of a table, so fingerprints need no exchange: they are made batch by batch where the contents are
scanned, and only the sample (about two of ``w + 1`` tokens) goes on. ``fingerprints_sql`` is the same in window functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweft.functions.hashing import KGRAM_BASE, MODULUS, code_point_hashes, kgram_hashes, token_hash
from textweft.operators.tokens import char_tokens, tokens_of

#: Arrays over a slice stay in the processor's cache.
SLICE_BYTES = 1 << 16
BATCH_BYTES = "16m"
FIELDS = ["p", "h", "start_row", "start_col", "end_row", "end_col"]


def winnow(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Indices of the k-grams to keep. ``h`` has the hashes of several sequences end to end, ``first`` where each begins.

    A k-gram is kept if it is the rightmost smallest of some trailing window of ``w``; windows at the beginning are shorter.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    first, sizes = first[sizes > 0], sizes[sizes > 0]
    place = np.arange(n)
    padded = np.full(n + len(first) * (w - 1), np.iinfo(np.int64).max)
    owner = np.repeat(np.arange(len(first)), sizes)
    at = place + (owner + 1) * (w - 1)
    # small hash first, then the larger place
    padded[at] = (h.astype(np.int64) << 36) | ((1 << 36) - 1 - place)
    # minimum of `width` trailing values, by doubling and one overlapping step
    low, width = padded, 1
    while width < w:
        step = min(width, w - width)
        moved = low.copy()
        moved[step:] = np.minimum(low[step:], low[:-step])
        low, width = moved, width + step
    best = (1 << 36) - 1 - (low[at] & ((1 << 36) - 1))
    fresh = np.concatenate([[True], best[1:] != best[:-1]])
    return best[fresh]


class Prints(NamedTuple):
    """Fingerprints of several texts: text, k-gram position and hash of each, and its region."""

    owner: np.ndarray
    p: np.ndarray
    h: np.ndarray
    regions: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def prints_of(hashes: np.ndarray, owner: np.ndarray, regions: tuple[np.ndarray, ...], n_texts: int, k: int, w: int) -> Prints:
    """Fingerprints of token hashes in order of text; ``regions`` are start and end (row, col) of the tokens. ``w`` 0 keeps all."""
    n = len(hashes) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Prints(none, none, none, (none,) * 4)
    first = np.searchsorted(owner, np.arange(n_texts))
    whole = np.flatnonzero(owner[:n] == owner[k - 1 :])
    h, who = kgram_hashes(hashes, k)[whole], owner[whole]
    kept = winnow(h, np.searchsorted(who, np.arange(n_texts)), w) if w else np.arange(len(h))
    at = whole[kept]
    return Prints(who[kept], at - first[who[kept]], h[kept], (regions[0][at], regions[1][at], regions[2][at + k - 1], regions[3][at + k - 1]))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def char_prints(texts: pa.Array, k: int, w: int) -> Prints:
    """Fingerprints of the characters of each text of an Arrow column without nulls."""
    data, offsets = _bytes_of(texts)
    t = char_tokens(data, offsets)
    hashes = code_point_hashes(data, t.lead, t.size)
    return prints_of(hashes, t.owner, (t.row, t.col, t.row, t.col + t.size), len(texts), k, w)


def tree_prints(texts: pa.Array, language: str, include_comments: bool, k: int, w: int) -> Prints:
    """Fingerprints of syntax trees. A text that can't be parsed, or is nested too deep for the parser, has none."""
    known: dict[str, int] = {}
    hashes, owner, regions = [], [], ([], [], [], [])
    for i, text in enumerate(texts.to_pylist()):
        try:
            tokens = tokens_of(text, language, include_comments)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        for token in tokens:
            if token.name not in known:
                known[token.name] = token_hash(token.name)
            hashes.append(known[token.name])
            owner.append(i)
            for r, v in zip(regions, token[1:], strict=True):
                r.append(v)
    return prints_of(np.array(hashes, np.int64), np.array(owner, np.int64), tuple(np.array(r, np.int64) for r in regions), len(texts), k, w)


def fingerprints(files: DataFrame, k: int, w: int, language: str = "char", include_comments: bool = False, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """``(file_id, idx, p, h, start_row, start_col, end_row, end_col)``: the fingerprints of each file, ``idx`` dense from 0.

    ``w`` 0 keeps every k-gram. A file of fewer than ``k`` tokens, or a null one, has none.
    """
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    own = files.select(F.col(file_id).alias("file_id"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch["content"]):
                prints = char_prints(texts, k, w) if language == "char" else tree_prints(texts, language, include_comments, k, w)
                cut = np.searchsorted(prints.owner, np.arange(len(texts) + 1))
                idx = np.arange(len(prints.owner)) - cut[prints.owner]
                rows = [idx, prints.p, prints.h, *prints.regions]
                arrays = [pa.array(x.astype(np.int64 if name == "h" else np.int32)) for name, x in zip(["idx", *FIELDS], rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["file_id"].take(pa.array(prints.owner + at)), *arrays], ["file_id", "idx", *FIELDS])

    id_type = own.schema["file_id"].dataType.simpleString()
    return own.mapInArrow(run, f"file_id {id_type}, idx int, p int, h bigint, start_row int, start_col int, end_row int, end_col int")


def char_counts(files: DataFrame) -> DataFrame:
    """``(file_id, tokens, lines, widest)`` of each file that has a token: its characters, the lines they are in, and the widest line's bytes."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    id_type = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch["content"]):
                t = char_tokens(*_bytes_of(texts))
                n = np.bincount(t.owner, minlength=len(texts))
                # a file's tokens are in order of their rows
                new = np.concatenate([[True], (t.owner[1:] != t.owner[:-1]) | (t.row[1:] != t.row[:-1])])[: len(t.owner)]
                widest = np.zeros(len(texts), np.int64)
                np.maximum.at(widest, t.owner, t.col + t.size)
                some = np.flatnonzero(n)
                counts = [n[some], np.bincount(t.owner[new], minlength=len(texts))[some], widest[some]]
                yield pa.RecordBatch.from_arrays([batch["file_id"].take(pa.array(some + at)), *(pa.array(c.astype(np.int64)) for c in counts)], ["file_id", "tokens", "lines", "widest"])

    return files.select("file_id", "content").mapInArrow(run, f"file_id {id_type}, tokens bigint, lines bigint, widest bigint")


def kgram_sums(files: DataFrame, k: int) -> DataFrame:
    """``(file_id, kgrams, sum_h)`` of each file that has a k-gram: the number and sum of its k-gram hashes."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    id_type = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch["content"]):
                prints = char_prints(texts, k, 0)
                n = np.bincount(prints.owner, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, prints.owner, prints.h)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([batch["file_id"].take(pa.array(some + at)), pa.array(n[some].astype(np.int64)), pa.array(total[some])], ["file_id", "kgrams", "sum_h"])

    return files.select("file_id", "content").mapInArrow(run, f"file_id {id_type}, kgrams bigint, sum_h bigint")


def kgrams_sql(tokens: DataFrame, k: int) -> DataFrame:
    """``(file_id, p, h)`` of every full k-gram of ``tokens(file_id, pos, th)``, by window functions."""
    order = Window.partitionBy("file_id").orderBy("pos")
    terms = [F.lag("th", m).over(order) * pow(KGRAM_BASE, m, MODULUS) for m in range(k)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return tokens.select("file_id", (F.col("pos") - (k - 1)).alias("p"), F.pmod(total, F.lit(MODULUS).cast("bigint")).alias("h")).filter("p >= 0")


def fingerprints_sql(tokens: DataFrame, k: int, w: int) -> DataFrame:
    """``(file_id, idx, p, h)`` of ``tokens(file_id, pos, th)``: distinct arg-minima of a trailing frame of ``w`` k-grams."""
    order = Window.partitionBy("file_id").orderBy("p")
    low = F.min(F.struct("h", (-F.col("p")).alias("np"))).over(order.rowsBetween(-(w - 1), 0))
    kept = kgrams_sql(tokens, k).select("file_id", low.alias("m")).distinct().select("file_id", (-F.col("m.np")).alias("p"), F.col("m.h").alias("h"))
    return kept.select("file_id", (F.row_number().over(order) - 1).alias("idx"), "p", "h")
