import pytest
from pyspark.sql import functions as F

from orelode.llm import sieve
from orelode.llm.jaccard import near_groups
from orelode.llm.simhash import keep_one


def test_no_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    passes = sieve.key_sieve(keys.unionAll(spark.sql("select cast(null as long) k")), "k")
    asked = spark.range(120_000).select("id", passes(F.xxhash64("id")).alias("p"))
    got = {r["m"]: r["n"] for r in asked.where("p").groupBy((F.col("id") < 20_000).alias("m")).agg(F.count("*").alias("n")).collect()}
    assert got[True] == 20_000 and got.get(False, 0) <= 0.016 * 100_000
    assert asked.where("p is null").count() == 0
    assert spark.sql("select cast(null as long) k").select(passes("k").alias("p")).first()["p"] is False
    none = sieve.key_sieve(keys.limit(0), "k")
    assert keys.where(none("k")).count() == 0


@pytest.mark.parametrize("full", [False, True])
def test_groups_and_kept_rows_with_a_full_sieve(docs, prose, odd_texts, monkeypatch, full):
    if full:  # of 400 keys nearly every bit is set
        monkeypatch.setattr(sieve, "_size", lambda n, most: 6)
    base = [prose(80, k) for k in range(60)]
    near = [t + " and one more word." for t in base]
    texts = odd_texts + base + near + base[:20]
    ids = [None if k == 3 else k for k in range(len(texts))]
    data = docs(texts + texts[-2:], ids + ids[-2:], k=["x"] * (len(texts) + 2))
    kept = keep_one(data, near_groups(data)).collect()
    first = len(odd_texts)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and r["doc_id"] >= first) == list(range(first, first + 60))
    words = [t.split() if t else [] for t in odd_texts]
    assert len(kept) == 60 + len({" ".join(w).lower() for w in words})


def test_nothing_goes_from_documents_without_copies(docs, prose):
    data = docs([prose(50, k) for k in range(20)])
    assert keep_one(data, near_groups(data)).count() == 20
    assert keep_one(docs([]), near_groups(docs([]))).count() == 0
