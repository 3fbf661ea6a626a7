"""Recommendation: item-based collaborative filtering, boosted regression on profiles, and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orelode.operators import boosting
from orelode.operators.relational import lookup, top_per_group

#: Defaults of the neighbour rule (fixed values).
MIN_CO_RATERS, MIN_CORRELATION, NEIGHBOURS, UNKNOWN_ITEM = 25, 0.2, 30, 4.0
FEATURES = ["user_idx", "item_idx", "user_avg", "user_n", "item_avg", "item_n"]


def item_means(ratings: DataFrame) -> DataFrame:
    """``item, mean, n`` over all ratings of an item."""
    return ratings.groupBy("item").agg(F.avg("stars").alias("mean"), F.count("*").alias("n"))


def item_correlations(ratings: DataFrame, min_co_raters: int = MIN_CO_RATERS) -> DataFrame:
    """``a < b, n, corr`` of item pairs with enough co-raters: Pearson over co-raters with means over all raters; 0 if a side doesn't vary.

    Deviations are taken before the join, so the pair rows carry two numbers and are summed before their shuffle.
    ``ratings (user, item, stars)`` has to hold a cell once.
    """
    deviation = ratings.join(item_means(ratings), "item").select("user", "item", (F.col("stars") - F.col("mean")).alias("d"))
    x, y = deviation.alias("x"), deviation.alias("y")
    pairs = x.join(y, "user").where(F.col("x.item") < F.col("y.item"))
    sums = pairs.groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(
        F.count("*").alias("n"), F.sum(F.col("x.d") * F.col("y.d")).alias("xy"), F.sum(F.col("x.d") * F.col("x.d")).alias("xx"), F.sum(F.col("y.d") * F.col("y.d")).alias("yy")
    )
    bottom = F.sqrt("xx") * F.sqrt("yy")
    return sums.where(F.col("n") >= min_co_raters).select("a", "b", "n", F.when(bottom == 0, F.lit(0.0)).otherwise(F.col("xy") / bottom).alias("corr"))


def neighbour_table(ratings: DataFrame, min_co_raters: int = MIN_CO_RATERS, min_correlation: float = MIN_CORRELATION) -> DataFrame:
    """``item, neighbour, corr`` in both directions, for correlations (to 6 places) that reach the bound."""
    pairs = item_correlations(ratings, min_co_raters).select("a", "b", F.round("corr", 6).alias("corr")).where(F.col("corr") >= min_correlation)
    both = F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("neighbour"), "corr"), F.struct(F.col("b").alias("item"), F.col("a").alias("neighbour"), "corr"))
    return pairs.select(F.inline(both))  # a union of both directions would correlate all pairs twice


def predict_ratings(ratings: DataFrame, targets: DataFrame, neighbours: DataFrame, k: int = NEIGHBOURS, unknown_item: float = UNKNOWN_ITEM) -> DataFrame:
    """``user, item, prediction, n_neighbours`` for each distinct target.

    Neighbours of the item that the user rated, the ``k`` best by (corr, neighbour), weigh the user's ratings; 0 if the weights sum
    to 0; clamped to [0, 5]. Unknown item: ``unknown_item``. Unknown user or no neighbour: the item's mean.
    ``n_neighbours`` is counted before the cut to ``k``.
    """
    cells = targets.select("user", "item").distinct()
    rated = cells.join(neighbours, "item").join(ratings.select("user", F.col("item").alias("neighbour"), "stars"), ["user", "neighbour"])
    order = [F.desc("corr"), F.desc("neighbour")]
    counted = rated.withColumn("n_neighbours", F.count("*").over(W.partitionBy("user", "item")))
    best = top_per_group(counted, ["user", "item"], order, k)
    weight = F.sum(F.abs("corr"))
    score = best.groupBy("user", "item").agg(F.when(weight == 0, F.lit(0.0)).otherwise(F.sum(F.col("corr") * F.col("stars")) / weight).alias("weighted"), F.max("n_neighbours").alias("n_neighbours"))
    known = cells.join(item_means(ratings).select("item", "mean"), "item", "left").join(score, ["user", "item"], "left")
    prediction = F.when(F.col("mean").isNull(), F.lit(unknown_item)).when(F.col("weighted").isNull(), F.col("mean")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col("weighted"))))
    return known.select("user", "item", prediction.alias("prediction"), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def user_profiles(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user").agg(F.avg("stars").alias("user_avg"), F.count("*").alias("user_n"))


def item_profiles(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item").agg(F.avg("stars").alias("item_avg"), F.count("*").alias("item_n"))


def build_features(cells: DataFrame, users: DataFrame, items: DataFrame, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """The six features of each cell: both indexes (-1 if unknown), and average and count of both profiles (0 if unknown)."""
    rows = lookup(cells, user_index.withColumnRenamed("idx", "user_idx"), "user", {"user_idx": -1})
    rows = lookup(rows, users, "user", {"user_avg": 0.0, "user_n": 0})
    rows = lookup(rows, item_index.withColumnRenamed("idx", "item_idx"), "item", {"item_idx": -1})
    return lookup(rows, items, "item", {"item_avg": 0.0, "item_n": 0})


def fit_regression(features: DataFrame, trees: int = 100, depth: int = 5, rate: float = 0.4, share: str = "0.1", seed: int = 0) -> boosting.BoostedTrees:
    """Boosted regression trees on the squared error of all rows; ``share`` of the features is drawn at each node. ``features`` should be a written table."""
    return boosting.fit(features, FEATURES, "stars", trees, depth, rate, share, seed)


def predict_regression(model: boosting.BoostedTrees, features: DataFrame) -> DataFrame:
    """``user, item, model`` for each cell; keys travel with the rows."""
    return boosting.predict(model, features, ["user", "item"], "model")


def blend_weight(n_neighbours: Column, high: float = 0.9, low: float = 0.1, cut: int = 50) -> Column:
    """The share of the item-based score: ``high`` with more than ``cut`` neighbours, else ``low``."""
    return F.when(n_neighbours > cut, F.lit(high)).otherwise(F.lit(low))


def blend(item_scores: DataFrame, model_scores: DataFrame, high: float = 0.9, low: float = 0.1, cut: int = 50) -> DataFrame:
    """``user, item, prediction``: alpha * item-based + (1 - alpha) * model, joined on the keys."""
    alpha = blend_weight(F.col("n_neighbours"), high, low, cut)
    met = item_scores.join(model_scores, ["user", "item"])
    return met.select("user", "item", (alpha * F.col("prediction") + (1 - alpha) * F.col("model")).alias("prediction"))
