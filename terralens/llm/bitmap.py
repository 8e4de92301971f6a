"""A filter of fixed size over 64-bit keys, for texts that stream by in Python.

A key marks one bit in each of two bitmaps, by its first and by its last ``BITS`` bits: 4 MB together whatever the
number of keys, built by one partial aggregation (at most ``2 ** (BITS - 5)`` words come to the driver) and sent to
every executor. What it lets through is decided exactly by a join; with very many keys it lets more through and nothing
is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24
_LOW, _SIX = np.uint64((1 << BITS) - 1), np.uint64(63)


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The two bitmaps of the column ``key`` (bigint, hashed); nulls are left out."""
    first, last = F.shiftrightunsigned(F.col(key), 64 - BITS), F.col(key).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")) + (1 << BITS)
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(first, last)).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("m")).toPandas()
    out = np.zeros(2 << (BITS - 6), dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["m"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for each of ``keys`` (uint64) that both bitmaps mark."""
    out = np.ones(len(keys), dtype=bool)
    for at in (keys >> np.uint64(64 - BITS), (keys & _LOW) + np.uint64(1 << BITS)):
        out &= (bits[at >> np.uint64(6)] >> (at & _SIX)) & np.uint64(1) != 0
    return out
