"""Readers of the operators' input formats. Schemas are given, so no file is read twice to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orelode.functions.hashing import uniform_long


def _fields(spark: SparkSession, path: str, sep: str, header: bool) -> DataFrame:
    """Fields of each line as an array; a plain split, so quotes are ordinary characters. The header is each file's first line."""
    if not header:
        return spark.read.text(path).select(F.split("value", sep, -1).alias("f"))
    rows = spark.read.option("header", True).option("sep", sep).option("quote", "").option("inferSchema", False).csv(path)
    return rows.select(F.array(*[F.col(f"`{c}`") for c in rows.columns]).alias("f"))


def _field(i: int, kind: str = "string"):
    return F.try_element_at("f", F.lit(i + 1)).cast("string").try_cast(kind)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``basket_key, item`` from a CSV with header: first and second column joined by ``-``, and the sixth."""
    rows = _fields(spark, path, ",", header=True)
    return rows.select(F.concat_ws("-", _field(0), _field(1)).alias("basket_key"), _field(5).alias("item"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user, item, stars`` from a CSV with header; an unreadable or absent number is null."""
    return _fields(spark, path, ",", header=True).select(_field(0).alias("user"), _field(1).alias("item"), _field(2, "double").alias("stars"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``a, b`` from the first two columns of a CSV with header: the truth of a similarity join."""
    return _fields(spark, path, ",", header=True).select(F.least(_field(0), _field(1)).alias("a"), F.greatest(_field(0), _field(1)).alias("b"))


def read_user_profiles(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("user_id string, average_stars double, review_count long").json(path)
    return rows.select(F.col("user_id").alias("user"), F.col("average_stars").alias("user_avg"), F.col("review_count").alias("user_n"))


def read_item_profiles(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("business_id string, stars double, review_count long").json(path)
    return rows.select(F.col("business_id").alias("item"), F.col("stars").alias("item_avg"), F.col("review_count").alias("item_n"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` from lines of two names with a space between; lines without a second name are left out."""
    return _fields(spark, path, " ", header=False).select(_field(0).alias("src"), _field(1).alias("dst")).where("dst is not null")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``id, label, features`` from lines ``id,label,x1,x2,...``."""
    numbers = F.transform(F.slice("f", 3, F.size("f") - 2), lambda x: x.cast("double"))
    return _fields(spark, path, ",", header=False).where(F.size("f") > 2).select(_field(0, "long").alias("id"), _field(1, "int").alias("label"), numbers.alias("features"))


def ask_stream(lines: DataFrame, asks: int, ask_size: int, column: str = "value") -> DataFrame:
    """``seq, ask, user``: ``asks`` times ``ask_size`` lines drawn uniformly with replacement.

    Draw number ``seq`` takes the line whose rank is an md5-based uniform number, so it doesn't depend on partitions.
    """
    placed = lines.select(F.col(column).alias("user"), F.monotonically_increasing_id().alias("_row"))
    n = placed.count()
    if not n:
        return lines.sparkSession.createDataFrame([], "seq long, ask long, user string")
    counts = placed.groupBy(F.shiftright("_row", 33).alias("_part")).agg(F.count("*").alias("m"))
    starts = counts.select("_part", F.coalesce(F.sum("m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_part", F.shiftright("_row", 33)).join(F.broadcast(starts), "_part").select("user", (F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)).alias("_rank"))
    draws = lines.sparkSession.range(asks * ask_size).select(F.col("id").alias("seq"), F.pmod(uniform_long(F.col("id"), "ask"), F.lit(n)).alias("_rank"))
    return draws.join(ranked, "_rank").select("seq", F.floor(F.col("seq") / ask_size).cast("long").alias("ask"), "user")
