"""The operators' inputs, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.itemsets import build_baskets
from orelode.operators.similarity import distinct_incidence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of each order with more than four lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return build_baskets(lines.join(parts, "l_partkey"), "l_orderkey", "p_brand", 4)


def basket_support(rows: DataFrame) -> int:
    """One basket in a hundred, two at least."""
    return max(2, rows.select("basket_id").distinct().count() // 100)


def ratings(spark: SparkSession, sf_dir: str, test: bool | None = None) -> DataFrame:
    """``user, item, stars``: customers rate suppliers; of each cell the mean. Orders whose key is divisible by 5 are the test part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    if test is not None:
        lines = lines.where((F.col("l_orderkey") % 5 == 0) == test)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    star = 1 + (F.col("l_quantity").cast("long") - 1) % 5
    return lines.join(orders, "l_orderkey").groupBy("user", F.col("l_suppkey").alias("item")).agg(F.avg(star).alias("stars"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, member``: suppliers and the customers who bought of them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return distinct_incidence(lines.join(orders, "l_orderkey"), "l_suppkey", "o_custkey")


def _heavy(pairs: DataFrame, share: float) -> DataFrame:
    """Pairs ``(src, dst)`` whose number of rows reaches the discrete percentile."""
    weights = pairs.groupBy("src", "dst").agg(F.count("*").alias("w"))
    bound = weights.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY w)").alias("bound"))
    return weights.join(F.broadcast(bound)).where("w >= bound").select("src", "dst")


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth of nation pairs that trade most."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("a"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    met = lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey").where("a <> b")
    return _heavy(met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")), 0.8)


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twentieth of supplier pairs that meet most often in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    x, y = lines.alias("x"), lines.alias("y")
    met = x.join(y, "l_orderkey").where(F.col("x.l_suppkey") < F.col("y.l_suppkey"))
    return _heavy(met.select(F.col("x.l_suppkey").alias("src"), F.col("y.l_suppkey").alias("dst")), 0.95)


def user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, user`` of all events in order."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("features"))
