"""A sieve of keys: tells most rows that surely have no partner in a join, so that their texts needn't be shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, and the most bits of a sieve (32 MB): its size is bounded whatever the number of keys.
BITS_PER_KEY, MOST_BITS = 16, 28


def _size(n: int, most_bits: int) -> int:
    """Of how many bits (a power of two, given as exponent) a sieve of ``n`` keys is."""
    return min(most_bits, max(10, (BITS_PER_KEY * n - 1).bit_length()))


def key_sieve(keys: DataFrame, column: str, most_bits: int = MOST_BITS):
    """A function of a column of 64-bit digests: False only where the digest surely isn't in ``keys[column]``.

    Each key sets two bits. Of other digests 1.4 % pass at most, up to 17 million keys; beyond that more, in the end all. So it may only
    stand before a join that decides. Bits are put together before they reach the driver, which gets 2^28 of them at most. No
    keys: nothing passes. A null digest never passes, and null keys are left out.
    """
    keys = keys.select(F.col(column).cast("long").alias("k")).where("k is not null")
    size = _size(keys.count(), most_bits)
    place = F.explode(F.array(F.shiftrightunsigned("k", 64 - size), F.shiftrightunsigned(F.shiftleft("k", 32), 64 - size)))
    one = keys.select(place.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = one.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (size - 6), dtype=np.uint64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)

    @F.pandas_udf("boolean")
    def passes(digest: pd.Series) -> pd.Series:
        known = digest.notna().to_numpy()
        k = digest.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)
        out = known
        for p in (k >> np.uint64(64 - size), (k << np.uint64(32)) >> np.uint64(64 - size)):
            out = out & ((table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    return passes


def record_digest(doc_id: Column, text_hash: Column) -> Column:
    """64-bit digest of a record's name: its doc_id (null too) and its text's digest."""
    return F.xxhash64(doc_id.cast("long"), text_hash, F.lit(11))
