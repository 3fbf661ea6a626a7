"""Sharding by rendezvous hashing of record keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orelode.llm.common import materialize

#: Rows that are numbered in one group; a task holds no more of a shard at once.
BLOCK_ROWS = 1 << 15


def _score(key: Column, shard: int, weight: float, seed: int) -> Column:
    """``-weight / ln(u)`` with u in (0, 1) from the top 53 bits of a hash of (key, shard)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 to len(weights) - 1) whose score for the key is greatest; of equal ones the lowest.

    A shard of weight 0 gets no row. Each added shard takes rows only into itself, each removed one gives
    away only its own, and expected shares are proportional to the weights.
    """
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("weights have to be finite, not negative and not all zero")
    each = [F.struct(_score(key, s, w, seed).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return -(F.greatest(*each) if len(each) > 1 else each[0])["shard"]


def shard_records(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Place every row: key, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (with one more shard of mean weight).

    ``size`` is the text's UTF-8 bytes (null: none) plus 1, ``text_crc32`` the unsigned crc32 of them. ``slot``
    counts a shard's rows from 0 without gaps. Rows with a null key go where the empty key goes; equal
    rows get one shard and different slots. Slots are numbered in blocks of at most ``BLOCK_ROWS`` rows of
    a written table, and a block's start is the sum of the counts before it, so no task has to hold a shard.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    more = [*weights, sum(weights) / len(weights)]
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(name, weights, seed).alias("shard"),
        rendezvous(name, more, seed).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return number_within(materialize(placed, "shards"), "shard", "slot").drop("_row")


def number_within(table: DataFrame, group: str, name: str, row: str = "_row", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``name``: 0, 1, ... within each value of ``group``, in the order of ``row``.

    ``table`` has to be a written one, as it is read twice; ``row`` is its monotonically increasing id.
    """
    blocked = table.withColumn("_block", F.shiftright(row, block_rows.bit_length() - 1))
    local = blocked.withColumn("_local", F.row_number().over(W.partitionBy(group, "_block").orderBy(row)) - 1)
    counts = blocked.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return local.join(starts, [group, "_block"]).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_block", "_local", "_start")
