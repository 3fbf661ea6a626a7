"""Similar items: MinHash signatures, banding, verified Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.hashing import MULTIPLIERS, linear_hash
from orelode.operators.relational import dense_index, set_overlap


def distinct_incidence(rows: DataFrame, item: str, member: str) -> DataFrame:
    """``item, member`` once each, without nulls: who occurs with what."""
    return rows.select(F.col(item).alias("item"), F.col(member).alias("member")).where("item is not null and member is not null").distinct()


def minhash_signatures(incidence: DataFrame, multipliers: list[int] = MULTIPLIERS) -> DataFrame:
    """``item, sig``: for each multiplier p the least ``(p * index + 7) mod n`` over the item's members.

    ``index`` is the member's rank among all ``n`` members. The minima of all functions come from one aggregation, so rows
    are neither multiplied by functions nor shuffled before partial minima are taken.
    """
    index = dense_index(incidence, "member")
    n = index.count()
    rows = incidence.join(index, "member")
    mins = rows.groupBy("item").agg(*[F.min(linear_hash(F.col("idx"), p, max(1, n))).alias(f"m{i}") for i, p in enumerate(multipliers)])
    return mins.select("item", F.array(*[f"m{i}" for i in range(len(multipliers))]).alias("sig"))


def band_buckets(signatures: DataFrame, rows: int = 2) -> DataFrame:
    """``item, band, key``: the parts of ``rows`` values of each signature."""
    bands = F.transform(F.sequence(F.lit(0), F.floor(F.size("sig") / rows).cast("int") - 1), lambda b: F.slice("sig", b * rows + 1, F.lit(rows)))
    return signatures.select("item", F.posexplode(bands).alias("band", "key"))


def lsh_candidates(signatures: DataFrame, rows: int = 2) -> DataFrame:
    """Pairs ``a < b`` that share a bucket in some band, each once."""
    buckets = band_buckets(signatures, rows)
    pairs = buckets.alias("x").join(buckets.alias("y"), ["band", "key"]).where(F.col("x.item") < F.col("y.item"))
    return pairs.select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).distinct()


def pair_jaccard(incidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, jaccard`` of the given pairs, from counts: both / (a + b - both). Pairs without a common member are left out."""
    sizes = incidence.groupBy("item").agg(F.count("*").alias("n"))
    both = set_overlap(incidence, pairs, "item", "member")
    met = both.join(sizes.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    return met.select("a", "b", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"))


def co_occurring_pairs(incidence: DataFrame) -> DataFrame:
    """Pairs ``a < b`` with a common member, with ``n_both``."""
    x, y = incidence.alias("x"), incidence.alias("y")
    pairs = x.join(y, "member").where(F.col("x.item") < F.col("y.item"))
    return pairs.groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.count("*").alias("n_both"))


def exact_jaccard(incidence: DataFrame, threshold: float) -> DataFrame:
    """``a, b, jaccard`` of all pairs that reach ``threshold``: the truth that candidates are measured against."""
    sizes = incidence.groupBy("item").agg(F.count("*").alias("n"))
    met = co_occurring_pairs(incidence).join(sizes.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    return met.select("a", "b", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_pairs(incidence: DataFrame, threshold: float = 0.5, multipliers: list[int] = MULTIPLIERS, rows: int = 2) -> DataFrame:
    """LSH candidates whose exact Jaccard reaches ``threshold``: precision 1, recall that of the bands."""
    return pair_jaccard(incidence, lsh_candidates(minhash_signatures(incidence, multipliers), rows)).where(F.col("jaccard") >= threshold)
