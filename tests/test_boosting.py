"""Boosted trees against a plain loop over the same bins, independence of partitions, number of passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orelode.operators import recommend


def boosting_rows(spark, n=3000):
    draw = np.random.default_rng(3)
    columns = [draw.integers(0, 900, n), draw.integers(-1, 20, n), draw.normal(0, 1e-3, n), draw.integers(0, 3, n) ** 9, draw.uniform(1, 5, n), np.zeros(n)]
    stars = np.clip(np.sign(columns[2]) * (columns[1] % 3) + columns[4] + draw.normal(0, 0.2, n), 0, 8)
    frame = pd.DataFrame(dict(zip(recommend.FEATURES, columns, strict=True)) | {"stars": stars, "user": range(n), "item": 0})
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("share", ["0.1", "0.5", "all"])
def test_boosting_against_a_plain_loop(spark, share):
    frame, cells = boosting_rows(spark)
    model = recommend.fit_regression(cells, trees=14, share=share)
    bins = np.stack([np.searchsorted(bound, frame[c]) for c, bound in zip(recommend.FEATURES, model.bounds, strict=True)])
    assert bins.max() == 31 and len(set(bins[3].tolist())) == 3 and len(set(bins[1].tolist())) == 21
    assert max(np.bincount(bins[0])) < 2 * len(frame) / 32
    score = np.full(len(frame), model.start / model.scale)
    draw = np.random.default_rng(0)
    for tree in model.trees:
        drawn = [sorted(draw.permutation(6)[: {"0.1": 1, "0.5": 3, "all": 6}[share]].tolist()) for _ in range(31)]
        rest, node = frame["stars"].to_numpy() - score, np.zeros(len(frame), dtype=int)
        for v in range(31):
            own = node == v

            def error(f, cut, own=own, rest=rest):
                return sum(((rest[part] - rest[part].mean()) ** 2).sum() for part in (own & (bins[f] <= cut), own & (bins[f] > cut)) if part.any())

            if own.any():
                least = min(error(f, cut) for f in drawn[v] for cut in range(32))
                assert tree.feature[v] in drawn[v] and abs(error(tree.feature[v], tree.cut[v]) - least) < 1e-3
            node[own] = 2 * v + 1 + (bins[tree.feature[v]] > tree.cut[v])[own]
        for leaf in range(32):
            own = node == 31 + leaf
            if own.any():
                assert abs(tree.leaf[leaf] / model.scale - 0.4 * rest[own].mean()) < 1e-5
                score[own] += tree.leaf[leaf] / model.scale
    found = recommend.predict_regression(model, cells).toPandas().sort_values("user")
    assert np.abs(found["model"].to_numpy() - score).max() < 1e-9


def test_boosting_takes_few_passes_whose_results_do_not_depend_on_partitions(spark):
    _, cells = boosting_rows(spark, 500)
    found = []
    for parts in (1, 7):
        spark.sparkContext.setJobGroup(f"boosting-{parts}", "")
        model = recommend.fit_regression(cells.repartition(parts, "user_avg"), trees=12)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{parts}")) < 4 * 12 + 20
        found.append(sorted(map(tuple, recommend.predict_regression(model, cells).select("user", "model").collect())))
    assert found[0] == found[1]


def test_boosting_odd_rows(spark):
    _, cells = boosting_rows(spark, 40)
    assert {r["model"] for r in recommend.predict_regression(recommend.fit_regression(cells.where("false")), cells).collect()} == {0.0}
    flat = recommend.fit_regression(cells.withColumn("stars", F.lit(0.0)), trees=2)
    assert {r["model"] for r in recommend.predict_regression(flat, cells).collect()} == {0.0}
    alike = recommend.fit_regression(cells.withColumn("stars", F.lit(3.0)), trees=2)
    assert {r["model"] for r in recommend.predict_regression(alike, cells).collect()} == {3.0}
    assert recommend.predict_regression(alike, cells.where("false")).count() == 0


def test_neighbours_correlate_pairs_once(spark):
    train = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(30) for i in range(4)], "user long, item long, stars double")
    plan = recommend.neighbour_table(train, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sqrt") == recommend.item_correlations(train, 3)._jdf.queryExecution().optimizedPlan().toString().count("sqrt")
