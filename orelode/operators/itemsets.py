"""Frequent itemsets: level by level, with candidates pruned by their subsets; PCY buckets; FP-growth as the fast path."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.checkpoint import materialize


def build_baskets(transactions: DataFrame, basket: str, item: str, threshold: int) -> DataFrame:
    """Distinct ``(basket_id, item)`` of baskets with more than ``threshold`` rows, counted before duplicates go."""
    rows = transactions.select(F.col(basket).alias("basket_id"), F.col(item).alias("item")).where("basket_id is not null and item is not null")
    counted = rows.groupBy("basket_id", "item").agg(F.count("*").alias("n"))  # one row for each pair; both steps need one shuffle of them
    large = counted.groupBy("basket_id").agg(F.sum("n").alias("n")).where(F.col("n") > threshold).select("basket_id")
    return counted.select("basket_id", "item").join(large, "basket_id", "left_semi")


def item_counts(baskets: DataFrame, support: int) -> DataFrame:
    """``itemset`` (one item) and ``support`` of the frequent items."""
    return baskets.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support).select(F.array("item").alias("itemset"), "support")


def candidates(frequent: DataFrame, size: int) -> DataFrame:
    """Itemsets of ``size + 1`` items whose every subset of ``size`` items is in ``frequent``.

    Two frequent sets that share all but their last item make one; then each of its subsets has to be found.
    """
    sets = frequent.select("itemset")
    prefix = F.slice("itemset", 1, size - 1) if size > 1 else F.array().cast("array<string>")
    parts = sets.select(prefix.alias("prefix"), F.element_at("itemset", -1).alias("last"))
    made = parts.alias("x").join(parts.alias("y"), F.col("x.prefix") == F.col("y.prefix")).where(F.col("x.last") < F.col("y.last"))
    made = made.select(F.concat("x.prefix", F.array("x.last", "y.last")).alias("itemset"))
    if size == 1:
        return made
    subsets = F.transform(F.sequence(F.lit(1), F.lit(size + 1)), lambda i: F.filter("itemset", lambda x, k: k + 1 != i))
    checked = made.select("itemset", F.explode(subsets).alias("subset")).join(sets.withColumnRenamed("itemset", "subset"), "subset", "left_semi")
    return checked.groupBy("itemset").agg(F.count("*").alias("n")).where(F.col("n") == size + 1).select("itemset")


def pcy_buckets(baskets: DataFrame, support: int, buckets: int = 10_000, code: Column | None = None) -> DataFrame:
    """``bucket`` and ``n`` of the hash buckets of item pairs that reach ``support``: no pair of another bucket can be frequent.

    A pair's bucket is the sum of its items' codes modulo ``buckets``. ``code`` is an item's number; without one its crc32 serves.
    """
    code = F.crc32(F.col("item").cast("binary")) if code is None else code
    rows = baskets.select("basket_id", "item", code.alias("code"))
    pairs = rows.alias("x").join(rows.alias("y"), "basket_id").where(F.col("x.item") < F.col("y.item"))
    return pairs.groupBy(F.pmod(F.col("x.code") + F.col("y.code"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= support)


def frequent_itemsets(baskets: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """``size, itemset, support`` of every itemset in at least ``support`` baskets, items sorted within a set.

    A level counts only sets that occur: occurrences of the level before, extended by a later frequent item of the basket, kept if
    they are candidates. Each level's occurrences and result are written tables. No frequent item gives an
    empty result.
    """
    ones = materialize(item_counts(baskets, support), "itemsets-1")
    alive = materialize(baskets.join(ones.select(F.col("itemset")[0].alias("item")), "item", "left_semi").select("basket_id", "item"), "items")
    occurrences, result, frequent, size = alive.select("basket_id", F.array("item").alias("itemset")), ones.withColumn("size", F.lit(1)), ones, 1
    while (max_size is None or size < max_size) and frequent.limit(size + 1).count() > size:
        longer = occurrences.join(alive, "basket_id").where(F.col("item") > F.element_at("itemset", -1)).select("basket_id", F.concat("itemset", F.array("item")).alias("itemset"))
        if size > 1:  # all pairs of frequent items are candidates anyway
            longer = longer.join(candidates(frequent, size), "itemset", "left_semi")
        size += 1
        frequent = materialize(longer.groupBy("itemset").agg(F.count("*").alias("support")).where(F.col("support") >= support), f"itemsets-{size}")
        result = result.unionByName(frequent.withColumn("size", F.lit(size)))
        if max_size is None or size < max_size:
            occurrences = materialize(longer.join(frequent.select("itemset"), "itemset", "left_semi").select("basket_id", "itemset"), f"occurrences-{size}")
    return result.select("size", "itemset", "support")


def frequent_itemsets_fp(baskets: DataFrame, support: int) -> DataFrame:
    """The same result from Spark's FP-growth, which never enumerates pairs in a basket."""
    arrays = baskets.groupBy("basket_id").agg(F.collect_set("item").alias("items"))
    n = arrays.count()
    if not n:
        return baskets.sparkSession.createDataFrame([], "size int, itemset array<string>, support long")
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(arrays)
    found = model.freqItemsets.where(F.col("freq") >= support)
    return found.select(F.size("items").alias("size"), F.array_sort("items").alias("itemset"), F.col("freq").alias("support"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """Report lines ``size, line``: ``('a')`` for single items, ``('a', 'b')`` for larger sets."""
    quoted = F.array_join(F.transform("itemset", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return itemsets.select("size", F.concat(F.lit("("), quoted, F.lit(")")).alias("line"))
