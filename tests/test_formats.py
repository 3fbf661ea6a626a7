"""Readers and writers round-trip; streams give what the batch operators give."""

import glob
import json

from pyspark.sql import functions as F

from orelode.operators import graph, itemsets, sketches
from orelode.sources import readers, writers
from orelode.streaming import streams


def text(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('date,cust,c,d,e,item\n1/1,7,x,x,x,42\n1/1,7,x,"q,x,43\n')
    assert sorted(map(tuple, readers.read_transactions(spark, str(tmp_path / "t.csv")).collect())) == [("1/1-7", "42"), ("1/1-7", "43")]
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\nu,b,4.0\nu,c,bad\n")
    assert sorted(map(tuple, readers.read_ratings(spark, str(tmp_path / "r.csv")).collect())) == [("u", "b", 4.0), ("u", "c", None)]
    (tmp_path / "e.txt").write_text("a b\nb c\nalone\n")
    assert sorted(map(tuple, readers.read_edges(spark, str(tmp_path / "e.txt")).collect())) == [("a", "b"), ("b", "c")]
    (tmp_path / "p.txt").write_text("1,0,0.5,1.5\n2,1,2,3\n")
    assert sorted(map(tuple, readers.read_points(spark, str(tmp_path / "p.txt")).collect())) == [(1, 0, [0.5, 1.5]), (2, 1, [2.0, 3.0])]
    (tmp_path / "u.json").write_text(json.dumps({"user_id": "u", "average_stars": 3.5, "review_count": 2, "more": 1}) + "\n")
    assert readers.read_user_profiles(spark, str(tmp_path / "u.json")).first()[:] == ("u", 3.5, 2)
    (tmp_path / "b.json").write_text(json.dumps({"business_id": "b", "stars": 3.5, "review_count": 2}) + "\n")
    assert readers.read_item_profiles(spark, str(tmp_path / "b.json")).first()[:] == ("b", 3.5, 2)
    (tmp_path / "s.csv").write_text("business_id_1,business_id_2\nz,a\n")
    assert readers.read_pairs(spark, str(tmp_path / "s.csv")).first()[:] == ("a", "z")


def test_ask_stream(spark):
    lines = spark.createDataFrame([(f"u{k}",) for k in range(10)], "value string").repartition(3)
    drawn = readers.ask_stream(lines, 4, 25)
    assert drawn.count() == 100 and drawn.groupBy("ask").count().where("count = 25").count() == 4
    assert drawn.select("user").distinct().count() > 5
    assert readers.ask_stream(lines.limit(0), 4, 25).count() == 0


def test_writers(spark, tmp_path):
    data = spark.createDataFrame([(k, x) for k, g in enumerate(["abc", "ab", "bc"]) for x in g], "basket_id long, item string")
    found = itemsets.frequent_itemsets(data, 2)
    singles = found.where("size = 1").select("itemset")
    pairs = itemsets.candidates(found.where("size = 1"), 1)
    writers.write_itemset_report(singles.unionAll(pairs), found, str(tmp_path / "i"))
    want = "Candidates:\n('a'),('b'),('c')\n\n('a', 'b'),('a', 'c'),('b', 'c')\n\nFrequent Itemsets:\n('a'),('b'),('c')\n\n('a', 'b'),('b', 'c')\n\n"
    assert text(tmp_path / "i") == want
    writers.write_pairs(spark.createDataFrame([("y", "z", 0.5), ("a", "b", 1.0)], "a string, b string, jaccard double").coalesce(1), str(tmp_path / "p"))
    assert "business_id_1,business_id_2, similarity\na,b,1.0\n" in text(tmp_path / "p")
    writers.write_predictions(spark.createDataFrame([("u", "b", 0.5)], "user string, item string, prediction double").coalesce(1), str(tmp_path / "q"))
    assert text(tmp_path / "q") == "user_id,business_id, prediction\nu,b,0.5\n"
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    writers.write_betweenness(graph.edge_betweenness(edges), str(tmp_path / "b"))
    assert text(tmp_path / "b") == "('a', 'b') 2.0\n('b', 'c') 2.0\n"
    labels = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "id string, label int").coalesce(1)
    writers.write_communities(graph.communities(labels), str(tmp_path / "c"))
    assert text(tmp_path / "c") == "'c'\n'a', 'b'\n"
    rounds = spark.createDataFrame([(1, 5, 0, 0, 1)], "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    writers.write_clustering(spark.createDataFrame([(1, 0)], "id long, cluster int").coalesce(1), rounds, str(tmp_path / "k"))
    assert text(tmp_path / "k" / "rounds") == "Round 1: 5,0,0,1\n" and text(tmp_path / "k" / "clusters") == "1,0\n"


def events(spark, tmp_path, n=600, files=3):
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 7919 % 83).alias("user_id"))
    for k in range(files):
        rows.where(f"event_id >= {k * n // files} and event_id < {(k + 1) * n // files}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"))


def test_stream_registers_equal_batch(spark, tmp_path):
    batch = events(spark, tmp_path)
    seen = {}
    live = streams.stream_distinct_registers(streams.read_user_stream(spark, str(tmp_path / "in")), 100)
    streams.run_available(live, lambda df, _: seen.update({r["ask"]: r["estimate"] for r in streams.combine_registers(df).collect()}), str(tmp_path / "ck"), "update")
    assert seen == {r["ask"]: r["estimate"] for r in sketches.distinct_estimates(batch, 100).collect()}


def test_stream_reservoir_and_first_seen_equal_batch(spark, tmp_path):
    batch = events(spark, tmp_path)
    slots, firsts = {}, {}
    source = streams.read_user_stream(spark, str(tmp_path / "in"))
    streams.run_available(streams.stream_reservoir(source, 20), lambda df, _: slots.update({r["slot"]: r["user"] for r in df.collect()}), str(tmp_path / "ck1"), "complete")
    want = sketches.reservoir_changes(batch, 20).groupBy("slot").agg(F.max_by("user", "seq").alias("u"))
    assert slots == {r["slot"]: r["u"] for r in want.collect()} and len(slots) == 20
    streams.run_available(streams.stream_first_seen(source), lambda df, _: firsts.update({r["user"]: r["first"] for r in df.collect()}), str(tmp_path / "ck2"), "update")
    assert firsts == {r["user"]: r["f"] for r in batch.groupBy("user").agg(F.min("seq").alias("f")).collect()}


def test_stream_bloom_equals_the_sequential_filter(spark, tmp_path):
    batch = events(spark, tmp_path, n=300)
    found = {}
    streams.run_available(streams.stream_bloom(streams.read_user_stream(spark, str(tmp_path / "in")), 211), lambda df, _: found.update({r["seq"]: r["n_set"] for r in df.collect()}), str(tmp_path / "ck"))
    flags, want = set(), {}
    for r in batch.orderBy("seq").collect():
        own = [(p * int.from_bytes(r["user"].encode(), "big") + 7) % 211 for p in (2, 3, 5)]
        want[r["seq"]] = sum(b in flags for b in own)
        flags |= set(own)
    assert found == want


def test_stream_windows(spark, tmp_path):
    events(spark, tmp_path)
    found = {}
    streams.run_available(streams.stream_windowed_distinct(streams.read_user_stream(spark, str(tmp_path / "in"))), lambda df, _: found.update({r["start"]: r["estimate"] for r in df.collect()}), str(tmp_path / "ck"), "update")
    assert len(found) == 10
