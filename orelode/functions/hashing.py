"""Hash families as column expressions: long arithmetic that any SQL engine repeats."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the linear hash functions (fixed values; the 22nd, 77, is not a prime and stays as it is).
MULTIPLIERS = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 77, 79, 83]
OFFSET = 7


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, isqrt(n) + 1))


def next_prime(n: int) -> int:
    """The least prime that is ``n`` or above it."""
    while not is_prime(n):
        n += 1
    return n


def linear_hash(x: Column, multiplier: int, modulus: int | Column, offset: int = OFFSET) -> Column:
    """``(multiplier * x + offset) mod modulus``; ``x`` has to be reduced so that the product fits a long."""
    return (x * multiplier + offset) % modulus


def text_residue(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of ``text`` as one big-endian number, modulo ``modulus``: folded byte by byte, so never wider than a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(digits) > 0, F.aggregate(byte, F.lit(0).cast("long"), lambda a, b: (a * 256 + b) % modulus)).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest one bit; -1 for 0, so that 0 never raises a maximum."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def uniform_long(key: Column, salt: str, digits: int = 12) -> Column:
    """A uniform long below 16 ** digits from the md5 of ``salt:key``: the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, digits), 16, 10).cast("long")
