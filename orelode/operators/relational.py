"""The relational steps that the mining operators are composed of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orelode.checkpoint import materialize


def composite_key(*parts: str, sep: str = "-") -> Column:
    return F.concat_ws(sep, *[F.col(p).cast("string") for p in parts])


def canonical_pairs(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges with the smaller end first; parallel edges stay."""
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def lookup(rows: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for missing keys; Spark broadcasts ``table`` if its measured size allows."""
    met = rows.join(table.select(key, *defaults), key, "left")
    return met.select(*[c for c in rows.columns], *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()])


def dense_index(df: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """Each distinct non-null value with its rank 0, 1, ...: values are range-partitioned, so no task ranks them all.

    Ranks within a partition come from its sorted order, and a partition's first rank is the sum of the
    sizes before it; only those sizes, one for each partition, meet in one task.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = values.repartitionByRange(F.col(column)).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_rank"))
    table = materialize(placed, "dense-index")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = table.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return table.join(F.broadcast(sizes), "_part").select(column, (F.col("_start") + F.col("_rank")).cast("long").alias(index))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark drops most before the shuffle (group limit)."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def first_seen(rows: DataFrame, key: str, order: str, name: str = "first") -> DataFrame:
    """The least ``order`` at which each key occurs."""
    return rows.groupBy(key).agg(F.min(order).alias(name))


def set_overlap(incidence: DataFrame, pairs: DataFrame, owner: str, member: str) -> DataFrame:
    """``a, b, n_both`` for each pair of owners: members that both have. ``incidence`` has to be distinct."""
    left = incidence.select(F.col(owner).alias("a"), F.col(member).alias("_m"))
    right = incidence.select(F.col(owner).alias("b"), F.col(member).alias("_m"))
    return pairs.select("a", "b").join(left, "a").join(right, ["b", "_m"]).groupBy("a", "b").agg(F.count("*").alias("n_both"))
