"""Structured Streaming variants: the same numbers as the batch operators, from a stream of ``(seq, user)``.

Windows are counts of events (asks), so state is one row for each ask, user or slot; only the Bloom filter's bits are in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orelode.functions.hashing import MULTIPLIERS, OFFSET, linear_hash, next_prime, text_residue, trailing_zeros
from orelode.operators.sketches import BLOOM_BITS, BLOOM_MULTIPLIERS, ask_of, reservoir_changes


def read_user_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """``seq, user, ts`` from a folder of Parquet files with ``event_id``, ``user_id``, ``ts``, read as they come."""
    rows = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"), "ts")


def stream_distinct_registers(stream: DataFrame, ask_size: int = 300, multipliers: list[int] = MULTIPLIERS) -> DataFrame:
    """``ask, n_events, r0 ...``: each ask's registers (most trailing zeros of each function), updated as events come.

    Registers are maxima, so the state of an ask is one row and repeated users need no memory.
    """
    modulus = next_prime(int(ask_size * 2.8))
    rows = stream.select(ask_of(ask_size).alias("ask"), text_residue(F.col("user"), modulus).alias("s"))
    return rows.groupBy("ask").agg(F.count("*").alias("n_events"), *[F.max(trailing_zeros(linear_hash(F.col("s"), p, modulus))).alias(f"r{i}") for i, p in enumerate(multipliers)])


def combine_registers(registers: DataFrame, groups: int = 3) -> DataFrame:
    """``ask, estimate``: mean of powers in groups, floored, then their median."""
    names = [c for c in registers.columns if c[0] == "r" and c[1:].isdigit()]
    size = len(names) // groups
    power = lambda c: F.when(F.col(c) < 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.col(c)))
    means = [F.floor(sum((power(c) for c in names[g * size + 1 : (g + 1) * size]), power(names[g * size])) / size) for g in range(groups)]
    return registers.select("ask", F.array_sort(F.array(*means))[groups // 2].cast("long").alias("estimate"))


def stream_windowed_distinct(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``start, estimate`` of users by event time, with a watermark: the variant for streams that have times."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.approx_count_distinct("user").alias("estimate")).select(F.col("window.start").alias("start"), "estimate")


def stream_first_seen(stream: DataFrame) -> DataFrame:
    """``user, first``: the exact record of who came when, as state spread over users (update or complete mode).

    With it, ``bloom_false_positives`` gives each ask's rate without passing events through one place.
    """
    return stream.groupBy("user").agg(F.min("seq").alias("first"))


def stream_bloom(stream: DataFrame, bits: int = BLOOM_BITS, multipliers: list[int] = BLOOM_MULTIPLIERS) -> DataFrame:
    """``seq, user, n_set`` of every event in order: how many of its bits were set before it (all: taken as seen).

    The state is the filter, ``bits`` bytes, whatever the number of users. One filter is one sequence, so its events go through
    one task; micro-batches have to come in order of ``seq``.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags = bytearray(state.get[0]) if state.exists else bytearray(bits)
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=["seq", "user", "s"])]).sort_values("seq")
        lit = []
        for s in rows["s"]:
            own = [(p * s + OFFSET) % bits for p in multipliers]
            lit.append(sum(flags[b] for b in own))
            for b in own:
                flags[b] = 1
        state.update((bytes(flags),))
        yield rows[["seq", "user"]].assign(n_set=lit)

    rows = stream.select("seq", "user", text_residue(F.col("user"), bits).alias("s"), F.lit(0).alias("filter"))
    return rows.groupBy("filter").applyInPandasWithState(fold, "seq long, user string, n_set int", "flags binary", "append", GroupStateTimeout.NoTimeout)


def stream_reservoir(stream: DataFrame, size: int = 100) -> DataFrame:
    """``slot, user, seq``: the reservoir so far, as one row of state for each slot (complete mode)."""
    changes = reservoir_changes(stream, size)
    return changes.groupBy("slot").agg(F.max_by("user", "seq").alias("user"), F.max("seq").alias("seq"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run what is there to the end, batch by batch, through ``foreachBatch``; a restart goes on from ``checkpoint``."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
