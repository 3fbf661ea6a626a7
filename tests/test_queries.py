"""Registered queries against their SQL on the smallest tables, and what the registry has to hold."""

import os

import duckdb
import pytest

from orelode.plans.oracle import oracle_sql
from orelode.plans.queries import REGISTRY

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def values(frame, columns):
    part = frame[columns].astype(object)
    return sorted(map(str, part.where(part.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = REGISTRY[name](spark, DATA).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert values(got, columns) == values(want, columns)


@pytest.mark.parametrize("partitions", [1, 13])
@pytest.mark.parametrize("name", ["freq_triples", "cf_predict", "lpa_labels", "bloom_fpr_strict", "reservoir_snapshots"])
def test_partitions_change_nothing(spark, name, partitions):
    want = REGISTRY[name](spark, DATA).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = REGISTRY[name](spark, DATA).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert values(got, sorted(got.columns)) == values(want, sorted(want.columns))


def test_hybrid_blends_both_scores(spark):
    items = {(r["user"], r["item"]): r for r in REGISTRY["cf_predict"](spark, DATA).collect()}
    model = {(r["user"], r["item"]): r["model"] for r in REGISTRY["mb_predict"](spark, DATA).collect()}
    found = {(r["user"], r["item"]): r["prediction"] for r in REGISTRY["hybrid_predict"](spark, DATA).collect()}
    assert found and found.keys() == items.keys() == model.keys()
    for k, x in found.items():
        share = 0.9 if items[k]["n_neighbours"] > 50 else 0.1
        assert abs(x - share * items[k]["prediction"] - (1 - share) * model[k]) < 1e-5


def test_registry():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(REGISTRY) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert set(oracle_sql()) <= set(REGISTRY)
