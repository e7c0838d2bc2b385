"""Vectorised text work over Arrow string columns: words, word hashes and k-word shingles without a Python loop per row.

Words are maximal runs of ASCII letters, digits, underscore and all non-ASCII code points, in lower case. A hash of a word
is a polynomial over its bytes modulo 2**64, read off a running sum, and mixed; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SHINGLE = 5
#: A slice has about so many bytes, so that its arrays stay in the processor's cache; one text is never cut.
SLICE_BYTES = 1 << 19
#: Arrow batches between Spark and Python.
BATCH_BYTES = "8m"

_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def small_batches(spark) -> None:
    """Bounds the bytes of an Arrow batch, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + U(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, U(b))])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[tuple[int, pa.Array]]:
    """Pieces of a string column of about ``most`` bytes and at most ``rows`` rows, with the row where each begins. Nulls become empty."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(int(np.searchsorted(ends, before + most, "right")), at + rows))
        yield at, texts.slice(at, stop - at)
        at = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words(NamedTuple):
    """The words of some texts. ``first[i]:first[i + 1]`` are those of row i; start and end are offsets in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of UTF-8 bytes; no word crosses the beginning of a row."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _WORD[data]
    opens = np.zeros(n + 1, bool)
    opens[off[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | opens[1:]
    begin[n] = False
    finish = np.zeros(n + 1, bool)
    finish[1:] = inside[:-1] & (~inside[1:] | opens[1:])
    finish[n] = n > 0 and inside[n - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish)


def words(texts: pa.Array, fold: bool = True) -> Words:
    """Words of a string column without nulls; in lower case if ``fold``."""
    data, off = raw(pc.utf8_lower(texts) if fold else texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64), none, np.zeros(0, U))
    start, end = bounds(data, off)
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, first, row, mix((sums[end] - sums[start]) * inverse[start]))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the word where each begins."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for i in range(k):
        total += w.hash[i : i + n] * U(((2 * i + 3) * 0xD1B54A32D192ED03 | 1) & (2**64 - 1))
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return mix(total[at], k), at


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each k-word shingle, repeats included; a row of fewer words has one shingle of all its words."""
    h, at = grams(w, k)
    row = w.row[at]
    counts = np.diff(w.first)
    extra_h, extra_row = [h], [row]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.zeros(len(short), U)
            for i in range(n):
                total += w.hash[w.first[short] + i] * U(((2 * i + 3) * 0xD1B54A32D192ED03 | 1) & (2**64 - 1))
            extra_h.append(mix(total, n))
            extra_row.append(short)
    return np.concatenate(extra_h), np.concatenate(extra_row)


HASH48 = U((1 << 48) - 1)


ROWS = 1 << 16


def weighted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, 48 bits of hash) in order, with the number of times each occurs. An error if a row isn't below ``ROWS``."""
    if len(row) and int(row.max()) >= ROWS:
        raise ValueError(f"rows must be below {ROWS}")
    key = np.sort((row.astype(U) << U(48)) | (h >> U(16)))
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return key & HASH48, (key >> U(48)).astype(np.int64), count


def range_keys(w: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run ``first[i]:last[i]`` of words; equal sequences have equal keys."""
    n = len(w.hash)
    if n == 0:
        return np.zeros(len(first), U), np.zeros(len(first), U)
    power, inverse = _power_tables(n + 1)
    keys = []
    for seed in (11, 12):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash, seed) * power[:n])])
        keys.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U), seed))
    return keys[0], keys[1]


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's sequence of words."""
    return range_keys(w, w.first[:-1], w.first[1:])


def code_points(data: np.ndarray) -> np.ndarray:
    """``out[i]``: code points that begin before byte i."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
