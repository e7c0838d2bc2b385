"""A table of bits that lets by all wanted keys and few others, for scans that would else send most rows on in vain.

Its size follows the number of keys and has a bound (``FILTER_BITS``, 16 MB). Past that it only lets more rows by: an exact join
always follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 27


def place_of(key: Column, width: int) -> Column:
    """The bit of a key, as a long."""
    return F.pmod(F.xxhash64(key), F.lit(1 << width))


def bit_table(keys: DataFrame, column: str, most: int = FILTER_BITS, hashed: bool = False) -> tuple[int, np.ndarray]:
    """The size in bits, as a power of two, and the bytes of a table with a bit for each of ``keys[column]``.

    The size is 16 to 32 bits a key. If ``hashed`` the low bits of a key are its place.
    """
    n = keys.count()
    width = max(16, min(most, int(16 * n).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << width) - 1)) if hashed else place_of(F.col(column), width)
    words = keys.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros((1 << width) // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return width, table.view(np.uint8)


def member(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
