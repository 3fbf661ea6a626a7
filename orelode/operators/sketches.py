"""Stream summaries over ordered events: Bloom filter, Flajolet-Martin distinct counts, fixed-size reservoir.

Input is ``(seq, user)`` with ``seq`` counting from 0; an ask is a run of ``ask_size`` events.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orelode.functions.hashing import MULTIPLIERS, OFFSET, linear_hash, next_prime, text_residue, trailing_zeros, uniform_long

BLOOM_BITS, BLOOM_MULTIPLIERS = 69_997, [2, 3, 5]


def ask_of(ask_size: int):
    return F.floor(F.col("seq") / ask_size).cast("long")


def _fpr(users: DataFrame, ask_size: int) -> DataFrame:
    """``ask, fp, tn, fpr`` from new users with ``first``, ``is_fp``, ``is_tn``."""
    rows = users.select(F.floor(F.col("first") / ask_size).cast("long").alias("ask"), F.col("is_fp").cast("long").alias("fp"), F.col("is_tn").cast("long").alias("tn"))
    return rows.groupBy("ask").agg(F.sum("fp").alias("fp"), F.sum("tn").alias("tn"))


def _with_asks(stream: DataFrame, counts: DataFrame, ask_size: int) -> DataFrame:
    asks = stream.select(ask_of(ask_size).alias("ask")).distinct()
    zero = F.lit(0).cast("long")
    met = asks.join(counts, "ask", "left").select("ask", F.coalesce("fp", zero).alias("fp"), F.coalesce("tn", zero).alias("tn"))
    return met.withColumn("fpr", F.round(F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)), 6))


def bloom_false_positives(stream: DataFrame, ask_size: int = 100, bits: int = BLOOM_BITS, multipliers: list[int] = BLOOM_MULTIPLIERS) -> DataFrame:
    """``ask, fp, tn, fpr`` of the standard filter, in which every new user sets all its bits.

    A bit is set from the first event of any user that hashes to it. A new user is a false positive if all its bits were
    set before it came, a true negative if none was: minima and maxima, so no pass in stream order.
    """
    users = stream.groupBy("user").agg(F.min("seq").alias("first")).withColumn("s", text_residue(F.col("user"), bits))
    own = users.select("user", "first", F.explode(F.array(*[linear_hash(F.col("s"), p, bits) for p in multipliers])).alias("bit"))
    since = own.groupBy("bit").agg(F.min("first").alias("since"))
    state = own.join(since, "bit").groupBy("user", "first").agg(F.max("since").alias("latest"), F.min("since").alias("earliest"))
    return _with_asks(stream, _fpr(state.select("first", (F.col("latest") < F.col("first")).alias("is_fp"), (F.col("earliest") == F.col("first")).alias("is_tn")), ask_size), ask_size)


def bloom_false_positives_strict(stream: DataFrame, ask_size: int = 100, bits: int = BLOOM_BITS, multipliers: list[int] = BLOOM_MULTIPLIERS) -> DataFrame:
    """As above, but a user is inserted only if all its bits are 0; users that meet some set bits count as neither.

    All hashes follow from the user's residue modulo ``bits``, so the fold in stream order runs over the first event of each
    residue: at most ``bits`` rows, however many users there are.
    """
    users = stream.groupBy("user").agg(F.min("seq").alias("first")).withColumn("s", text_residue(F.col("user"), bits))
    firsts = users.groupBy("s").agg(F.min("first").alias("first")).orderBy("first").collect()
    since = np.full(bits, np.iinfo(np.int64).max)
    for row in firsts:
        own = [(p * row["s"] + OFFSET) % bits for p in multipliers]
        if all(since[b] > row["first"] for b in own):
            since[own] = row["first"]
    spark = stream.sparkSession
    table = spark.createDataFrame([(int(b), int(t)) for b, t in enumerate(since) if t < np.iinfo(np.int64).max] or [(-1, 0)], "bit long, since long")
    own = users.select("user", "first", F.explode(F.array(*[linear_hash(F.col("s"), p, bits) for p in multipliers])).alias("bit"))
    met = own.join(F.broadcast(table), "bit", "left").withColumn("was_set", F.coalesce(F.col("since") < F.col("first"), F.lit(False)))
    state = met.groupBy("user", "first").agg(F.every("was_set").alias("is_fp"), (~F.some("was_set")).alias("is_tn"))
    return _with_asks(stream, _fpr(state, ask_size), ask_size)


def distinct_estimates(stream: DataFrame, ask_size: int = 300, multipliers: list[int] = MULTIPLIERS, groups: int = 3) -> DataFrame:
    """``ask, truth, estimate``: users of each ask, exactly and by Flajolet-Martin.

    Each function keeps the most trailing zeros of its hashes (modulo the next prime above 2.8 times the ask), R; 2^R is averaged
    in groups and floored, the median of the groups is floored. All functions are maxima of one aggregation.
    """
    modulus = next_prime(int(ask_size * 2.8))
    users = stream.select(ask_of(ask_size).alias("ask"), "user").distinct().withColumn("s", text_residue(F.col("user"), modulus))
    most = users.groupBy("ask").agg(F.count("*").alias("truth"), *[F.max(trailing_zeros(linear_hash(F.col("s"), p, modulus))).alias(f"r{i}") for i, p in enumerate(multipliers)])
    powers = [F.when(F.col(f"r{i}") < 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.col(f"r{i}"))) for i in range(len(multipliers))]
    size = len(multipliers) // groups
    means = [F.floor(sum(powers[g * size : (g + 1) * size][1:], powers[g * size]) / size) for g in range(groups)]
    ordered = F.array_sort(F.array(*means))
    middle = ordered[groups // 2] if groups % 2 else (ordered[groups // 2 - 1] + ordered[groups // 2]) / 2
    return most.select("ask", "truth", F.floor(middle).cast("long").alias("estimate"))


def reservoir_changes(stream: DataFrame, size: int = 100) -> DataFrame:
    """``slot, seq, user`` of every event that enters the reservoir.

    The first ``size`` events fill the slots. Event number n after them enters with chance size / n, at a uniform slot;
    both draws come from the md5 of its number. About ``size * ln(n / size)`` events enter.
    """
    n = F.col("seq") + 1
    enters = (n <= size) | (F.pmod(uniform_long(F.col("seq"), "keep"), n) < size)
    slot = F.when(n <= size, F.col("seq")).otherwise(F.pmod(uniform_long(F.col("seq"), "slot"), F.lit(size)))
    return stream.where(enters).select(slot.alias("slot"), "seq", "user")


def reservoir_snapshots(stream: DataFrame, size: int = 100, ask_size: int = 100, shown: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """``seqnum`` and the users in some slots after each full ask: the last entry of each slot up to then."""
    changes = reservoir_changes(stream, size).where(F.col("slot").isin(*shown))
    spans = changes.select("slot", "user", "seq", F.lead("seq").over(W.partitionBy("slot").orderBy("seq")).alias("until"))
    asks = stream.groupBy(ask_of(ask_size).alias("ask")).agg(F.count("*").alias("n")).where(F.col("n") == ask_size).select(((F.col("ask") + 1) * ask_size).alias("seqnum"))
    # Few rows in spans by construction, so each ask meets them in memory.
    met = asks.join(F.broadcast(spans), (F.col("seq") < F.col("seqnum")) & (F.col("until").isNull() | (F.col("until") >= F.col("seqnum"))), "left")
    return met.groupBy("seqnum").agg(*[F.max(F.when(F.col("slot") == s, F.col("user"))).alias(f"id_{s}") for s in shown])
