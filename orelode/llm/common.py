"""What the training-data operators share: table reading, durable cuts of the lineage, record keys."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.checkpoint import materialize

__all__ = ["bounded_sample", "char_codes", "crc_mod", "materialize", "read_table", "slabs", "small_batches", "spread_join", "text_hash"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let no more than ``rows`` rows go to a Python worker at once: texts may be long, and a batch is held whole, twice.

    It lowers a setting of the session, as plans are carried out only later; a lower one stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def text_hash(column: str = "text") -> Column:
    """64-bit digest of a text; with the document's id it names a record (equal rows are one record)."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], many: str) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``many``, joined by ``keys``, without a task that takes a hot key's rows.

    ``table`` holds a key once, and in ``many`` how often ``rows`` do. Keys with over a ten-thousandth of the rows, fewer than 10,000 ones,
    go to all tasks; only rows of other keys are shuffled. Both tables should be written ones, as they are read twice.
    """
    total = table.agg(F.sum(many)).first()[0] or 0
    often = F.col(many) > total / 10_000
    hot = F.broadcast(table.where(often).drop(many))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~often).drop(many), keys)
    return rows.join(hot, keys).unionByName(rest)


def bounded_sample(df: DataFrame, key: str, limit: int, seed: int = 7) -> DataFrame:
    """The ``limit`` rows that come first by a hash of the key: the same rows at any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(limit)


def char_codes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text starts (one more entry: the end)."""
    parts = [t if isinstance(t, str) else "" for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, starts


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after a task, beside others on its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slabs(frames: Iterator[pd.DataFrame], column: str, most_chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Cut each frame so that a slab holds about ``most_chars`` characters of ``column``, one row at least."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = np.cumsum(sizes) // most_chars
        for _, part in frame.groupby(group, sort=False):
            yield part
        del frame
        release_memory()
