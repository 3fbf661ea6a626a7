"""The corpus queries on the smallest tables: registered, complete, and equal to SQL where there is some."""

import os
import zlib

import duckdb
import numpy as np
import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}


def test_urls_equal_sql(spark):
    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["op3_url_filter"]).df()
    got = __spark_entry__.queries()["op3_url_filter"](spark, DATA).toPandas()[list(want.columns)]
    key = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_models_on_held_out_rows(spark):
    import __spark_entry__

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    lang = __spark_entry__.queries()["op1_language"](spark, DATA).toPandas().merge(docs, on="doc_id")
    assert len(lang) == len(docs) and (lang["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in lang["doc_id"]]).all()
    held = lang[lang["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    kept = __spark_entry__.queries()["op5_quality"](spark, DATA).toPandas().merge(labels, on="doc_id")
    assert kept[kept["quality_y"] == 1]["kept"].mean() > 0.9
    toxic = __spark_entry__.queries()["op6_toxicity"](spark, DATA).toPandas()
    assert (toxic["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in toxic["doc_id"]]).all() and np.isfinite(toxic["score"]).all()
