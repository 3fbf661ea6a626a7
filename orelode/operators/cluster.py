"""Clustering from sufficient statistics: N, SUM, SUMSQ of each cluster, diagonal Mahalanobis distance, chunk by chunk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.checkpoint import materialize
from orelode.operators.relational import dense_index

#: A dimension that doesn't vary counts with this deviation.
LEAST_STD = 1e-9


def cluster_statistics(points: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """``label, dim, n, sum, sumsq, centroid, std`` for each cluster and dimension (long form, so any width aggregates in parts)."""
    long = points.select(label, F.posexplode(features).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = long.groupBy(label, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))
    mean = F.col("sum") / F.col("n")
    return sums.select(label, "dim", "n", "sum", "sumsq", mean.alias("centroid"), F.sqrt(F.greatest(F.lit(0.0), F.col("sumsq") / F.col("n") - mean * mean)).alias("std"))


@dataclass
class Summary:
    """Statistics of some clusters as arrays; adding two summaries adds their points."""

    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, statistics: DataFrame, label: str = "label") -> tuple[list, Summary]:
        """From :func:`cluster_statistics`: bounded by clusters times dimensions."""
        rows = statistics.select(label, "dim", "n", "sum", "sumsq").toPandas().sort_values([label, "dim"])
        names = sorted(rows[label].unique().tolist())
        shape = (len(names), -1)
        return names, cls(rows.groupby(label)["n"].first().to_numpy(dtype=float), rows["sum"].to_numpy().reshape(shape), rows["sumsq"].to_numpy().reshape(shape))

    @property
    def centroid(self) -> np.ndarray:
        return self.total / self.n[:, None]

    @property
    def std(self) -> np.ndarray:
        return np.maximum(np.sqrt(np.maximum(self.squares / self.n[:, None] - self.centroid**2, 0)), LEAST_STD)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cluster of each row and the distance, cluster by cluster."""
        best, at = np.full(len(x), np.inf), np.full(len(x), -1)
        for k, (c, s) in enumerate(zip(self.centroid, self.std, strict=True)):
            d = np.sqrt((((x - c) / s) ** 2).sum(axis=1))
            at, best = np.where(d < best, k, at), np.minimum(d, best)
        return at, best


def assign_nearest(points: DataFrame, names: list, summary: Summary, features: str = "features") -> DataFrame:
    """``points`` with ``cluster`` and ``distance``: the nearest by the diagonal Mahalanobis distance.

    The summary travels with the function: clusters times dimensions, never a product of points and clusters.
    """

    @F.pandas_udf("cluster int, distance double")
    def near(x: pd.Series) -> pd.DataFrame:
        at, d = summary.nearest(np.stack(x.to_numpy()).astype(float)) if len(x) else (np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"cluster": np.array(names, dtype=int)[at] if len(names) else at, "distance": d})

    return points.withColumn("_near", near(features)).select(*points.columns, "_near.cluster", "_near.distance")


def _kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    rows = points.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="part").fit(rows).transform(rows).drop("_v")


def _stack(points: DataFrame, column: str) -> tuple[list, Summary]:
    return Summary.of(cluster_statistics(points, column), column)


def _grow(old: Summary, more: Summary, at: list[int]) -> None:
    old.n[at] += more.n
    old.total[at] += more.total
    old.squares[at] += more.squares


def bfr(points: DataFrame, clusters: int, chunks: int = 5, multiplier: float = 2.0, seeds: tuple[int, int, int] = (22, 16, 22)) -> tuple[DataFrame, DataFrame]:
    """Bradley-Fayyad-Reina over ``points (id, features)``: ``(id, cluster)``, with -1 for outliers, and a row of counts for each round.

    Points are dealt to ``chunks`` by the rank of their id. The first chunk: k-means with 5 * ``clusters`` parts, singletons are set aside
    (retained set), k-means with ``clusters`` parts on the rest gives the discard set. Every later chunk: a point joins the nearest discard cluster
    within ``multiplier * sqrt(d)``, else the nearest compressed one, else it is retained; retained points are parted again
    and parts of two or more become compressed clusters, which merge while their centroids are that near. In the end compressed
    clusters join a discard cluster that near; the rest are outliers. Statistics are updated once a chunk, with counts after the additions.
    """
    index = dense_index(points, "id", "_k")
    n = index.count()
    rows = materialize(points.join(index, "id").select("id", "features", F.least(F.floor(F.col("_k") * chunks / max(n, 1)), F.lit(chunks - 1)).cast("int").alias("chunk")), "bfr-points")
    spark = points.sparkSession
    if not n:
        return spark.createDataFrame([], "id long, cluster int"), spark.createDataFrame([], "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    parts = materialize(_kmeans(rows.where("chunk = 0"), 5 * clusters, seeds[0]), "bfr-parts")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    large = parts.join(F.broadcast(sizes.where("n > 1").select("part")), "part", "left_semi").select("id", "features")
    kept = materialize(_kmeans(large, clusters, seeds[1]), "bfr-first")
    names, ds = _stack(kept, "part")
    limit = multiplier * np.sqrt(ds.total.shape[1])
    owners = kept.select("id", F.col("part").cast("int").alias("ds"), F.lit(None).cast("int").alias("cs"))
    retained = materialize(parts.join(F.broadcast(sizes.where("n = 1").select("part")), "part", "left_semi").select("id", "features"), "bfr-retained")
    empty = np.zeros((0, ds.total.shape[1]))
    cs, alias, counts = Summary(np.zeros(0), empty.copy(), empty.copy()), [], []  # alias: where each compressed cluster went

    def find(k: int) -> int:
        while alias[k] != k:
            k = alias[k]
        return k

    def compress(rest: DataFrame, seed: int) -> tuple[DataFrame, DataFrame | None]:
        nonlocal cs
        if rest.limit(5 * clusters).count() < 5 * clusters:
            return rest, None
        own = materialize(_kmeans(rest, 5 * clusters, seed), "bfr-retained-parts")
        some = own.groupBy("part").agg(F.count("*").alias("n"))
        joined = own.join(F.broadcast(some.where("n > 1").select("part")), "part", "left_semi")
        found, more = _stack(joined, "part")
        if not found:
            return own.select("id", "features"), None
        base = len(cs.n)
        cs = Summary(np.append(cs.n, more.n), np.vstack([cs.total, more.total]), np.vstack([cs.squares, more.squares]))
        alias.extend(range(base, base + len(found)))
        number = F.create_map(*[F.lit(x) for k, p in enumerate(found) for x in (p, base + k)])
        members = joined.select("id", F.lit(None).cast("int").alias("ds"), number[F.col("part")].cast("int").alias("cs"))
        return own.join(F.broadcast(some.where("n = 1").select("part")), "part", "left_semi").select("id", "features"), members

    def merge() -> None:
        live = sorted({find(k) for k in range(len(alias))})
        changed = True
        while changed:
            changed = False
            for i, a in enumerate(live):
                others = [b for b in live[i + 1 :]]
                if not others:
                    break
                own = Summary(cs.n[others], cs.total[others], cs.squares[others])
                at, d = own.nearest(cs.centroid[[a]])
                if d[0] < limit:
                    b = others[int(at[0])]
                    _grow(cs, Summary(cs.n[[b]], cs.total[[b]], cs.squares[[b]]), [a])
                    alias[b] = a
                    live.remove(b)
                    changed = True
                    break

    def note(k: int) -> None:
        live = sorted({find(c) for c in range(len(alias))})
        counts.append((k + 1, int(ds.n.sum()), len(live), int(cs.n[live].sum()) if live else 0, retained.count()))

    retained, members = compress(retained, seeds[2])
    owners = owners if members is None else owners.unionAll(members)
    note(0)
    for chunk in range(1, chunks):
        new = rows.where(F.col("chunk") == chunk).select("id", "features")
        near = assign_nearest(new, names, ds)
        to_ds = materialize(near.where(F.col("distance") < limit).select("id", "features", "cluster"), "bfr-ds")
        rest = near.where(~(F.col("distance") < limit)).select("id", "features")
        live = sorted({find(k) for k in range(len(alias))})
        if live:
            near = assign_nearest(rest, live, Summary(cs.n[live], cs.total[live], cs.squares[live]))
            to_cs = materialize(near.where(F.col("distance") < limit).select("id", "features", "cluster"), "bfr-cs")
            rest = near.where(~(F.col("distance") < limit)).select("id", "features")
            found, more = _stack(to_cs, "cluster")
            if found:
                _grow(cs, more, found)
            owners = owners.unionAll(to_cs.select("id", F.lit(None).cast("int"), F.col("cluster").cast("int")))
        found, more = _stack(to_ds, "cluster")
        if found:
            _grow(ds, more, [names.index(k) for k in found])
        owners = owners.unionAll(to_ds.select("id", F.col("cluster").cast("int"), F.lit(None).cast("int")))
        retained, members = compress(materialize(retained.unionAll(rest), "bfr-rest"), seeds[2])
        owners = owners if members is None else owners.unionAll(members)
        merge()
        note(chunk)
    final: dict[int, int] = {}
    for k in {find(k) for k in range(len(alias))}:
        at, d = ds.nearest(cs.centroid[[k]])
        final[k] = int(names[int(at[0])]) if d[0] < limit else -1
    place = {k: final[find(k)] for k in range(len(alias))}
    of = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("cs")] if place else F.lit(-1)
    labelled = owners.select("id", F.coalesce("ds", of).cast("int").alias("cluster")).unionAll(retained.select("id", F.lit(-1).alias("cluster")))
    return labelled, spark.createDataFrame(counts, "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
