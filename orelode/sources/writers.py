"""Writers of the operators' report formats. Rows are range-sorted, so part files in name order read as one sorted report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted_tuple(items: Column) -> Column:
    """``('a', 'b')``; a single item as ``('a')``."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``line``, in order: ``Candidates:``, a line of tuples for each size, ``Frequent Itemsets:``, likewise; a blank after each line.

    Both tables have ``size`` and ``itemset``; a report line holds all sets of a size, as the format asks.
    """
    both = candidates.select(F.lit(1).alias("part"), F.size("itemset").alias("size"), "itemset").unionAll(frequent.select(F.lit(2).alias("part"), F.size("itemset").alias("size"), "itemset"))
    lines = both.groupBy("part", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_set("itemset")), quoted_tuple), ",").alias("line"))
    heads = both.sparkSession.createDataFrame([(1, 0, "Candidates:"), (2, 0, "Frequent Itemsets:")], "part int, size int, line string")
    return heads.unionAll(lines.withColumn("line", F.concat("line", F.lit("\n")))).orderBy("part", "size").select("line")


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    itemset_report(candidates, frequent).write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """``business_id_1,business_id_2, similarity``, sorted."""
    rows = pairs.orderBy("a", "b").select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), F.col("jaccard").alias(" similarity"))
    rows.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).csv(path, header=True)


def write_predictions(scores: DataFrame, path: str) -> None:
    """``user_id,business_id, prediction``."""
    rows = scores.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), F.col("prediction").alias(" prediction"))
    rows.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).csv(path, header=True)


def write_communities(communities: DataFrame, path: str) -> None:
    """A community's quoted members on each line; small communities first, then by members."""
    communities.orderBy("size", "members").select("members").write.mode("overwrite").text(path)


def betweenness_lines(edges: DataFrame, space: bool = True) -> DataFrame:
    """``('a', 'b') v`` (or ``('a','b') v``), greatest first."""
    names = F.transform(F.array("src", "dst"), lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'")))
    line = F.concat(F.lit("("), F.array_join(names, ", " if space else ","), F.lit(") "), F.col("betweenness").cast("string"))
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("line"))


def write_betweenness(edges: DataFrame, path: str, space: bool = True) -> None:
    betweenness_lines(edges, space).write.mode("overwrite").text(path)


#: Header and columns of each stream result (fixed values).
STREAM_FORMATS = {
    "fpr": {"Time": "ask", "FPR": "fpr"},
    "distinct": {"Time": "ask", "Ground Truth": "truth", "Estimation": "estimate"},
    "reservoir": {"seqnum": "seqnum", "0_id": "id_0", "20_id": "id_20", "40_id": "id_40", "60_id": "id_60", "80_id": "id_80"},
}


def write_stream_result(result: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """One of ``STREAM_FORMATS`` as CSV, in order of its first column; ``mode="append"`` serves ``foreachBatch``."""
    columns = STREAM_FORMATS[kind]
    result.orderBy(next(iter(columns.values()))).select(*[F.col(c).alias(name) for name, c in columns.items()]).write.mode(mode).csv(path, header=True)


def write_clustering(labelled: DataFrame, rounds: DataFrame, path: str) -> None:
    """``path/rounds``: ``Round i: nDS,nCS_clusters,nCS_points,nRS``; ``path/clusters``: ``id,cluster``."""
    counts = F.concat_ws(",", "n_ds", "n_cs_clusters", "n_cs", "n_rs")
    rounds.orderBy("round").select(F.concat(F.lit("Round "), F.col("round"), F.lit(": "), counts).alias("line")).write.mode("overwrite").text(f"{path}/rounds")
    labelled.orderBy("id").select("id", "cluster").write.mode("overwrite").csv(f"{path}/clusters")
