"""Quality metrics, each a one-row DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``n_found, n_truth, n_both, precision, recall`` of two tables of the same columns, as sets; ratios are null over nothing."""
    a, b = found.distinct(), truth.distinct()
    both = a.intersect(b)
    flags = [df.select(F.lit(k).alias("k")) for k, df in (("a", a), ("b", b), ("c", both))]
    n = flags[0].unionAll(flags[1]).unionAll(flags[2]).agg(*[F.count_if(F.col("k") == k).alias(k) for k in "abc"])
    return n.select(
        F.col("a").alias("n_found"), F.col("b").alias("n_truth"), F.col("c").alias("n_both"),
        F.round(F.try_divide("c", "a"), 6).alias("precision"), F.round(F.try_divide("c", "b"), 6).alias("recall"),
    )


def rmse(scores: DataFrame, prediction: str, truth: str) -> DataFrame:
    """``n`` and ``rmse`` over rows where both are known."""
    known = scores.where(F.col(prediction).isNotNull() & F.col(truth).isNotNull())
    return known.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(truth), 2))), 6).alias("rmse"))


def normalized_mutual_information(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """``n`` and ``nmi``: mutual information over the mean of both entropies; 1 if both have one cluster."""
    # The sums need only counts of cells, rows and columns: H = log(n) - sum(c log c) / n.
    counted = labels.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").alias("c")).cube("t", "f").agg(F.sum("c").alias("c"), F.grouping_id("t", "f").alias("g"))
    level = lambda g: F.sum(F.when(F.col("g") == g, F.col("c") * F.log("c")))
    sums = counted.agg(F.sum(F.when(F.col("g") == 3, F.col("c"))).alias("n"), level(0).alias("s_cell"), level(1).alias("s_t"), level(2).alias("s_f"))
    h = lambda c: F.log("n") - F.col(c) / F.col("n")
    both = h("s_t") + h("s_f")
    return sums.select("n", F.round(F.when(both == 0, F.lit(1.0)).otherwise(2 * (both - h("s_cell")) / both), 6).alias("nmi"))
