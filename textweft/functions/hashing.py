"""Token and k-gram hashes: the constants, plain Python for reference, numpy for batches, and Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of all hashes, base of the k-gram polynomial, and factor of the token hash.
MODULUS = 33554393
KGRAM_BASE = 4194301
TOKEN_FACTOR = 747287


def token_hash(token: str) -> int:
    """Folds the UTF-8 bytes of a token."""
    h = 0
    for b in token.encode():
        h = (h + b) * TOKEN_FACTOR % MODULUS
    return h


def token_hash_column(token: Column) -> Column:
    """``token_hash`` as a Spark expression. For few distinct tokens; batches of text go through ``code_point_hashes``."""
    digits = F.hex(F.encode(token, "UTF-8"))
    places = F.sequence(F.lit(0), (F.octet_length(token) - 1).cast("int"))
    codes = F.transform(places, lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(token == "", F.lit(0).cast("bigint")).otherwise(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, b: (h + b) * TOKEN_FACTOR % MODULUS))


_BYTE = np.arange(256, dtype=np.int64) * TOKEN_FACTOR % MODULUS


def code_point_hashes(data: np.ndarray, lead: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """``token_hash`` of code points of UTF-8 bytes; ``lead`` are the offsets where they begin, ``size`` their bytes, else they are all."""
    size = np.diff(np.append(lead, len(data))) if size is None else size
    h = _BYTE[data[lead]]
    more = np.flatnonzero(size > 1)
    for i in range(1, 4):
        if not len(more):
            break
        h[more] = (h[more] + data[lead[more] + i]) * TOKEN_FACTOR % MODULUS
        more = more[size[more] > i + 1]
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` less a multiple of the modulus, in place, in [-MODULUS, 2 * MODULUS). Floats of whole numbers below 2**53 are exact."""
    q = np.floor(x * (1 / MODULUS))
    q *= MODULUS
    x -= q
    return x


def kgram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of every full k-gram of token hashes: entry i is that of ``tokens[i:i + k]``.

    The oldest token has the highest power. Powers of the base are combined by doubling, so a k-gram costs log k steps.
    """
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # runs of `width` tokens end to end: whole is their hash, out the hash of those taken so far
    whole, width = tokens.astype(np.float64), 1
    out, taken = None, 0
    left = k
    while left:
        if left & 1:
            # the new run stands after what is taken
            part = whole[taken : taken + n]
            if out is None:
                out = part.copy()
            else:
                out *= pow(KGRAM_BASE, width, MODULUS)
                out += part
                _reduced(out)
            taken += width
        left >>= 1
        if left:
            ahead = whole[width:]
            whole = whole[:-width] * pow(KGRAM_BASE, width, MODULUS)
            whole += ahead
            _reduced(whole)
            width *= 2
    out = out.astype(np.int64)
    out[out < 0] += MODULUS
    out[out >= MODULUS] -= MODULUS
    return out


def kgram_hash_naive(tokens: list[int], k: int) -> list[int]:
    """The same by the definition."""
    return [sum(t * pow(KGRAM_BASE, k - 1 - i, MODULUS) for i, t in enumerate(tokens[a : a + k])) % MODULUS for a in range(len(tokens) - k + 1)]
