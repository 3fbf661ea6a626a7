"""Tiny hand-checked inputs, properties, and independence of partitions."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orelode.functions.hashing import MULTIPLIERS, is_prime, next_prime, text_residue, trailing_zeros
from orelode.functions.metrics import normalized_mutual_information, precision_recall, rmse
from orelode.operators import cluster, graph, itemsets, recommend, similarity, sketches
from orelode.operators.relational import dense_index, symmetrise


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def baskets(spark, groups):
    return spark.createDataFrame([(k, x) for k, g in enumerate(groups) for x in g], "basket_id long, item string")


def test_tiny_baskets(spark):
    found = itemsets.frequent_itemsets(baskets(spark, ["abc", "ab", "bc"]), 2)
    assert {tuple(r["itemset"]): r["support"] for r in found.collect()} == {("a",): 2, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("b", "c"): 2}


@pytest.mark.parametrize("partitions", [1, 13])
def test_itemsets_against_counting(spark, partitions):
    rng = random.Random(partitions)
    groups = ["".join(rng.sample("abcdefgh", rng.randint(0, 6))) for _ in range(60)]
    want = Counter(c for g in groups for k in range(1, 7) for c in combinations(sorted(g), k))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    data = baskets(spark, groups)
    for f in (itemsets.frequent_itemsets, itemsets.frequent_itemsets_fp):
        assert {tuple(r["itemset"]): r["support"] for r in f(data, 5).collect()} == {k: v for k, v in want.items() if v >= 5}
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_no_itemsets(spark):
    assert itemsets.frequent_itemsets(baskets(spark, []), 2).count() == 0
    assert itemsets.frequent_itemsets(baskets(spark, ["ab"]), 2).count() == 0
    assert itemsets.frequent_itemsets_fp(baskets(spark, []), 2).count() == 0


def test_basket_threshold_counts_rows_before_duplicates(spark):
    data = spark.createDataFrame([(1, "a")] * 3 + [(2, "a"), (2, "b")], "k long, v string")
    assert rows(itemsets.build_baskets(data, "k", "v", 2), "basket_id", "item") == [(1, "a")]


def test_pcy_never_loses_a_frequent_pair(spark):
    data = baskets(spark, ["abc", "abd", "abe", "cde"])
    pairs = itemsets.frequent_itemsets(data, 2, 2).where("size = 2").collect()
    import zlib

    kept = {r["bucket"] for r in itemsets.pcy_buckets(data, 2).collect()}
    assert pairs and all(sum(zlib.crc32(x.encode()) for x in p["itemset"]) % 10_000 in kept for p in pairs)
    numbered = spark.createDataFrame([(k, x) for k, g in enumerate([(1, 2, 9), (1, 2), (9, 1)]) for x in map(str, g)], "basket_id long, item string")
    assert rows(itemsets.pcy_buckets(numbered, 2, 8, F.col("item").cast("long")), "bucket", "n") == [(2, 2), (3, 3)]


def test_hash_functions(spark):
    words = ["abc", "é9", "", "user 17"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text_residue(F.col("w"), 69_997).alias("r"))
    assert {r["w"]: r["r"] for r in df.collect()} == {w: int.from_bytes(w.encode(), "big") % 69_997 for w in words}
    zeros = spark.createDataFrame([(x,) for x in (8, 12, 1, 0)], "x long").select(trailing_zeros(F.col("x")).alias("z"))
    assert [r["z"] for r in zeros.collect()] == [3, 2, 0, -1]
    assert [next_prime(n) for n in (0, 2, 14, 103, 280, 281, 840)] == [2, 2, 17, 103, 281, 281, 853]
    assert [p for p in MULTIPLIERS if not is_prime(p)] == [77]


def test_dense_index_is_the_rank(spark):
    data = spark.range(0, 1000, 7).select((F.col("id") * 3 % 1001).alias("v")).unionAll(spark.range(5).select(F.col("id").alias("v"))).unionAll(spark.createDataFrame([(None,)], "v long"))
    want = sorted({r["v"] for r in data.collect() if r["v"] is not None})
    assert rows(dense_index(data, "v"), "idx", "v") == list(enumerate(want))


def test_jaccard_and_lsh(spark):
    data = spark.createDataFrame([("x", i) for i in (1, 2, 3)] + [("y", i) for i in (2, 3, 4)] + [("z", i) for i in (7, 8, 9)], "item string, member long")
    assert rows(similarity.exact_jaccard(data, 0.5), "a", "b", "jaccard") == [("x", "y", 0.5)]
    found = rows(similarity.similar_pairs(data, 0.5), "a", "b", "jaccard")
    assert set(found) <= {("x", "y", 0.5)}
    n = 7
    members = {1: 0, 2: 1, 3: 2, 4: 3, 7: 4, 8: 5, 9: 6}
    want = {k: [min((p * members[m] + 7) % n for m in s) for p in MULTIPLIERS] for k, s in {"x": (1, 2, 3), "y": (2, 3, 4), "z": (7, 8, 9)}.items()}
    assert {r["item"]: r["sig"] for r in similarity.minhash_signatures(data).collect()} == want


def test_precision_recall(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    b = spark.createDataFrame([(1, 2), (5, 6), (7, 8)], "a int, b int")
    assert tuple(precision_recall(a, b).first()) == (2, 3, 1, 0.5, 0.333333)
    assert tuple(precision_recall(a.limit(0), b).first())[3:] == (None, 0.0)


def ratings(spark, data):
    return spark.createDataFrame(data, "user string, item string, stars double")


def test_cold_start_and_prediction(spark):
    data = [(f"u{k}", i, s) for k in range(4) for i, s in (("a", 1.0 + k), ("b", 1.0 + k), ("c", 5.0 - k))]
    train = ratings(spark, [*data, ("v", "b", 5.0)])
    near = recommend.neighbour_table(train, min_co_raters=3)
    assert {(r["item"], r["neighbour"]) for r in near.collect()} == {("a", "b"), ("b", "a")}
    targets = spark.createDataFrame([("v", "a"), ("v", "nowhere"), ("nobody", "a"), ("v", "c")], "user string, item string")
    found = {(r["user"], r["item"]): r["prediction"] for r in recommend.predict_ratings(train, targets, near).collect()}
    assert found[("v", "nowhere")] == 4.0 and found[("nobody", "a")] == 2.5 and found[("v", "c")] == 3.5 and math.isclose(found[("v", "a")], 5.0)


def test_pearson_uses_means_over_all_raters(spark):
    train = ratings(spark, [("u", "a", 1.0), ("v", "a", 3.0), ("w", "a", 5.0), ("u", "b", 2.0), ("v", "b", 4.0)])
    da, db = [-2.0, 0.0], [-1.0, 1.0]
    want = sum(x * y for x, y in zip(da, db, strict=True)) / (math.sqrt(sum(x * x for x in da)) * math.sqrt(sum(y * y for y in db)))
    row = recommend.item_correlations(train, 2).first()
    assert (row["a"], row["b"], row["n"]) == ("a", "b", 2) and math.isclose(row["corr"], want)
    flat = ratings(spark, [("u", "a", 1.0), ("v", "a", 1.0), ("u", "b", 2.0), ("v", "b", 4.0)])
    assert recommend.item_correlations(flat, 2).first()["corr"] == 0.0


def test_blend_ends(spark):
    items = spark.createDataFrame([("u", "a", 2.0, 60), ("u", "b", 2.0, 50)], "user string, item string, prediction double, n_neighbours long")
    model = spark.createDataFrame([("u", "a", 4.0), ("u", "b", 4.0)], "user string, item string, model double")
    assert [round(x[1], 6) for x in rows(recommend.blend(items, model), "item", "prediction")] == [2.2, 3.8]
    assert [x[1] for x in rows(recommend.blend(items, model, 1.0, 1.0), "item", "prediction")] == [2.0, 2.0]
    assert [x[1] for x in rows(recommend.blend(items, model, 0.0, 0.0), "item", "prediction")] == [4.0, 4.0]


def test_regression_learns(spark):
    cells = spark.createDataFrame([(str(k % 7), str(k % 5), float(k % 5), k % 7, k % 5, 1.0, 2, float(k % 5), 3) for k in range(200)], "user string, item string, stars double, user_idx long, item_idx long, user_avg double, user_n long, item_avg double, item_n long")
    model = recommend.fit_regression(cells, trees=5, share="all")
    scores = recommend.predict_regression(model, cells).distinct()
    assert rmse(scores.join(cells, ["user", "item"]), "model", "stars").first()["rmse"] < 0.5


def stream(spark, users):
    return spark.createDataFrame(list(enumerate(users)), "seq long, user string")


def sequential_bloom(users, size, bits, strict):
    flags, seen, out = set(), set(), Counter()
    for k, u in enumerate(users):
        s = int.from_bytes(u.encode(), "big")
        own = {(p * s + 7) % bits for p in (2, 3, 5)}
        if u not in seen:
            out[k // size, "fp"] += own <= flags
            out[k // size, "tn"] += not own & flags
            if not strict or not own & flags:
                flags |= own
        seen.add(u)
    return [(a, out[a, "fp"], out[a, "tn"]) for a in range(-(-len(users) // size))]


@pytest.mark.parametrize("strict", [False, True])
def test_bloom_equals_the_sequential_filter(spark, strict):
    rng = random.Random(4)
    users = [f"u{rng.randint(0, 150)}" for _ in range(400)]
    f = sketches.bloom_false_positives_strict if strict else sketches.bloom_false_positives
    assert rows(f(stream(spark, users), 50, 211), "ask", "fp", "tn") == sequential_bloom(users, 50, 211, strict)
    assert rows(f(stream(spark, ["u1", "u2", "u1"]), 3), "fp", "tn", "fpr") == [(0, 2, 0.0)]
    assert f(stream(spark, []), 3).count() == 0


def test_distinct_estimates(spark):
    users = [f"user{k * 7 % 90}" for k in range(300)]
    modulus, tz = next_prime(int(300 * 2.8)), lambda x: -1 if not x else (x & -x).bit_length() - 1
    s = [int.from_bytes(u.encode(), "big") for u in set(users)]
    powers = [2.0 ** max(0, max(tz((p * x + 7) % modulus) for x in s)) for p in MULTIPLIERS]
    means = sorted(int(sum(powers[g * 8 : g * 8 + 8]) / 8) for g in range(3))
    assert rows(sketches.distinct_estimates(stream(spark, users)), "ask", "truth", "estimate") == [(0, len(set(users)), means[1])]


def test_reservoir(spark):
    users = [f"u{k}" for k in range(500)]
    data = stream(spark, users)
    changes = sorted(map(tuple, sketches.reservoir_changes(data).select("seq", "slot", "user").collect()))
    assert [c[1] for c in changes[:100]] == list(range(100)) and 100 < len(changes) < 450
    slots, want, at = {}, [], 0
    for end in range(100, 501, 100):
        while at < len(changes) and changes[at][0] < end:
            slots[changes[at][1]] = changes[at][2]
            at += 1
        want.append((end, *(slots[k] for k in (0, 20, 40, 60, 80))))
    assert rows(sketches.reservoir_snapshots(data), "seqnum", "id_0", "id_20", "id_40", "id_60", "id_80") == want


def edges(spark, text):
    return spark.createDataFrame([tuple(map(int, e.split("-"))) for e in text.split()], "src long, dst long")


BARBELL = "1-2 2-3 1-3 3-4 4-5 5-6 4-6"


@pytest.mark.parametrize("limit", [1000, 0])
def test_betweenness(spark, limit):
    assert rows(graph.edge_betweenness(edges(spark, "1-2 2-3 3-4"), limit), "src", "dst", "betweenness") == [(1, 2, 3.0), (2, 3, 4.0), (3, 4, 3.0)]
    found = {(r["src"], r["dst"]): r["betweenness"] for r in graph.edge_betweenness(edges(spark, BARBELL), limit).collect()}
    assert found[3, 4] == 9.0 and found[1, 2] == found[5, 6] == 1.0 and found[1, 3] == 4.0


def test_betweenness_sums_to_distances(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(20)}
    data = spark.createDataFrame(sorted(pairs), "src long, dst long")
    near = {v: {w for e in pairs for w in e if v in e and w != v} for v in range(12)}
    total = 0
    for s in near:
        level, todo = {s: 0}, [s]
        for v in todo:
            for w in near[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    todo.append(w)
        total += sum(level.values())
    for limit in (1000, 0):
        assert math.isclose(graph.edge_betweenness(data, limit).agg(F.sum("betweenness")).first()[0], total / 2)


def test_girvan_newman_parts_the_barbell(spark):
    found = graph.girvan_newman(edges(spark, BARBELL))
    assert rows(found, "id", "community") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    assert math.isclose(found.first()["modularity"], 5 / 14)
    labels = found.select("id", F.col("community").alias("label"))
    assert math.isclose(graph.modularity(edges(spark, BARBELL), labels).first()["q"], 5 / 14)


def test_label_propagation_and_components(spark):
    data = edges(spark, BARBELL + " 8-9 7-7")
    labels = graph.label_propagation(data)
    assert {r["label"] for r in labels.collect()} <= {r["id"] for r in graph.vertices(data).collect()}
    lone = spark.createDataFrame([(20,)], "id long")
    assert rows(graph.connected_components(data, lone), "id", "component") == [*((k, 1) for k in range(1, 7)), (7, 7), (8, 8), (9, 8), (20, 20)]
    long = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(long).agg(F.max("component"), F.count("*")).first()[:] == (0, 301)
    assert graph.connected_components(long.limit(0)).count() == 0
    assert rows(symmetrise(edges(spark, "1-2 1-2")), "src", "dst") == [(1, 2), (2, 1)]


def test_cluster_statistics(spark):
    data = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0])], "id long, label int, features array<double>")
    assert rows(cluster.cluster_statistics(data), "dim", "n", "sum", "sumsq", "centroid", "std") == [(0, 2, 4.0, 10.0, 2.0, 1.0), (1, 2, 6.0, 20.0, 3.0, 1.0)]


def test_bfr_finds_separate_clusters(spark):
    rng = random.Random(7)
    data = [(k, k % 3, [100.0 * (k % 3) + rng.gauss(0, 1), 50.0 * (k % 3) + rng.gauss(0, 1)]) for k in range(600)] + [(600, 9, [5000.0, -5000.0])]
    df = spark.createDataFrame(data, "id long, label int, features array<double>")
    labelled, rounds = cluster.bfr(df, 3)
    found = labelled.join(df, "id")
    assert found.count() == 601 and rounds.count() == 5
    assert normalized_mutual_information(found, "label", "cluster").first()["nmi"] > 0.95  # two in a hundred points lie beyond 2 * sqrt(2) deviations
    last = rounds.orderBy(F.desc("round")).first()
    assert last["n_ds"] + last["n_cs"] + last["n_rs"] == 601


def test_nmi_of_equal_and_constant_labels(spark):
    df = spark.createDataFrame([(0, 5, 1), (1, 6, 1), (1, 6, 1)], "a int, b int, c int")
    assert normalized_mutual_information(df, "a", "b").first()["nmi"] == 1.0
    assert normalized_mutual_information(df, "a", "c").first()["nmi"] == 0.0
    assert normalized_mutual_information(df, "c", "c").first()["nmi"] == 1.0
