"""Hot keys, short benchmark items, and every pipeline stage on odd rows and empty tables."""

from collections import Counter

from pyspark.sql import functions as F

from orelode.llm.common import spread_join
from orelode.llm.decontaminate import drop_contaminated, find_passages


def test_spread_join_equals_the_plain_join(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).where("k <> 5")
    table = rows.groupBy("k").agg(F.min("v").alias("low"), F.count("*").alias("many"))
    found = spread_join(rows, table, ["k"], "many")
    assert found.columns == ["k", "v", "low"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(table.drop("many"), "k").collect()))
    assert spread_join(rows.limit(0), table.limit(0), ["k"], "many").count() == 0


def test_short_items_are_whole_words_and_tiny_ones_whole_texts(spark, docs, prose):
    items = [(1, "Too short"), (None, "one two three four"), (3, "x, y!"), (4, ""), (5, None), (6, "..."), (7, "TOO-SHORT")]
    texts = ["it is too  short, says one", "it is tool shorts", "itistooshort", "tooshort", "X y", "x y z", "so one two three four", "one two three fours", "one two three fou", "", None, prose(200, 1)]
    table, data = spark.createDataFrame(items, "item_id long, text string"), docs(texts, begin=["x"] * len(texts))
    found = find_passages(data, table).collect()
    want = {(0, 1), (0, 7), (3, 1), (3, 7), (4, 3), (6, None)}
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == Counter(want)
    assert all(r["edits"] == 0 for r in found)
    assert {texts[r["doc_id"]][r["begin"] : r["end"]] for r in found} == {"too  short", "tooshort", "X y", "one two three four"}
    assert {r["doc_id"] for r in drop_contaminated(data, table).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_stages_on_odd_rows_and_empty_tables(spark, prose, tmp_path):
    import corpus_pipeline
    from orelode.checkpoint import materialize

    item = prose(30, 77)
    a, b, c, d, long = prose(120, 1), prose(120, 2), prose(120, 3), prose(120, 4), prose(9000, 5)
    rows = [(0, a), (1, a), (None, a), (2, b), (2, c), (3, d), (3, d), (4, None), (5, ""), (6, "tiny"), (7, prose(120, 6) + " " + item), (8, long), (None, prose(120, 7)), (9, " \n ")]
    extra = ["removed", "component_id", "fp", "spans", "score", "kept", "item_id", "text_hash", "n"]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    docs = spark.createDataFrame([(k, t, None, None, None, *(f"{c}!" for c in extra)) for k, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, item), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    full = [r for r in rows if r[1] and len(r[1]) > 10]
    one = [(0, a), (2, b), (2, c), (3, d), rows[10], (8, long), rows[12]]
    want = {"quality": full, "near_dedup": one, "substring_dedup": one, "decontaminate": [r for r in one if r[0] != 7]}
    now, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        direct = stage(spark, docs, str(tmp_path))  # each stage takes all odd rows, too
        assert direct.count() >= len(want.get(name, ()))
        now, empty = materialize(stage(spark, now, str(tmp_path)), name), stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
        if name != "pack":
            assert now.columns == docs.columns == empty.columns
            assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(want[name])
            assert all(r[x] == f"{x}!" for r in now.collect() for x in extra)
    assert {r["doc_id"] for r in now.collect()} == {r[0] for r in want["decontaminate"]}
