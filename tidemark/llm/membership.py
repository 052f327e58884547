"""A bit table over hashed keys: a prefilter of bounded size, whatever the number of keys.

The table has about 16 bits per key, from 2**16 up to 2**27 (16 MB). It is filled by Spark's bitmap aggregates, so at most
4,097 rows of 4 KB reach the driver. A set bit may be a false hit, which the join that
follows drops; a clear bit is never a member.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEWEST, MOST, PER_KEY = 16, 27, 16
_BUCKET = 1 << 15


def table_bits(keys: int) -> int:
    """Binary logarithm of the number of bits for so many keys."""
    return min(MOST, max(FEWEST, (PER_KEY * max(keys, 1) - 1).bit_length()))


def bit_table(df: DataFrame, key: Column) -> np.ndarray:
    """The table of the 64-bit hashes in ``key`` (their top bits are used)."""
    bits = table_bits(df.count())
    place = F.shiftrightunsigned(key, 64 - bits) + 1
    rows = df.where(key.isNotNull()).select(
        F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")) \
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, part in rows:
        at = (bucket - 1) * _BUCKET // 8
        got = np.frombuffer(bytes(part), np.uint8)[: len(out) - at]
        out[at:at + len(got)] = got
    return out


def may_contain(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - (len(bits) * 8 - 1).bit_length())).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
