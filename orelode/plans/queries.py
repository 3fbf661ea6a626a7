"""One query for each operator: (spark, sf_dir) to a DataFrame with plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.checkpoint import materialize
from orelode.functions.metrics import normalized_mutual_information, precision_recall, rmse
from orelode.operators import cluster, graph, itemsets, recommend, similarity, sketches
from orelode.operators.relational import dense_index, first_seen
from orelode.plans import fixtures as fx

#: Parameters at which the fixtures give results that aren't empty; the operators' defaults are the published ones.
JACCARD, BLOOM_BITS, ASK = 0.2, 211, 100

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def _baskets(spark, sf_dir) -> DataFrame:
    """The baskets as a written table, as the support and each level read them again."""
    return materialize(fx.baskets(spark, sf_dir), "baskets")


def _flat(df: DataFrame, column: str = "itemset", sep: str = ",") -> DataFrame:
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), sep))


@query
def baskets(spark, sf_dir):
    return fx.baskets(spark, sf_dir)


@query
def freq_singletons(spark, sf_dir):
    rows = _baskets(spark, sf_dir)
    return _flat(itemsets.item_counts(rows, fx.basket_support(rows)))


def _level(spark, sf_dir, size: int) -> DataFrame:
    rows = _baskets(spark, sf_dir)
    return _flat(itemsets.frequent_itemsets(rows, fx.basket_support(rows), size).where(F.col("size") == size).select("itemset", "support"))


@query
def freq_pairs(spark, sf_dir):
    return _level(spark, sf_dir, 2)


@query
def freq_triples(spark, sf_dir):
    return _level(spark, sf_dir, 3)


@query
def freq_itemsets(spark, sf_dir):
    rows = _baskets(spark, sf_dir)
    return _flat(itemsets.frequent_itemsets(rows, fx.basket_support(rows)))


@query
def freq_itemsets_fp(spark, sf_dir):
    rows = _baskets(spark, sf_dir)
    return _flat(itemsets.frequent_itemsets_fp(rows, fx.basket_support(rows)))


@query
def itemset_candidates(spark, sf_dir):
    rows = _baskets(spark, sf_dir)
    found = itemsets.frequent_itemsets(rows, fx.basket_support(rows), 2)
    return _flat(itemsets.candidates(found.where("size = 2").select("itemset", "support"), 2))


@query
def itemset_report(spark, sf_dir):
    rows = _baskets(spark, sf_dir)
    return itemsets.itemset_lines(itemsets.frequent_itemsets(rows, fx.basket_support(rows), 2))


@query
def pcy_buckets(spark, sf_dir):
    rows = _baskets(spark, sf_dir)
    return itemsets.pcy_buckets(rows, fx.basket_support(rows), code=F.regexp_extract("item", "[0-9]+", 0).cast("long"))


@query
def dense_user_index(spark, sf_dir):
    return dense_index(fx.feedback(spark, sf_dir), "member")


@query
def minhash_signatures(spark, sf_dir):
    return _flat(similarity.minhash_signatures(fx.feedback(spark, sf_dir)), "sig")


@query
def lsh_candidates(spark, sf_dir):
    return similarity.lsh_candidates(similarity.minhash_signatures(fx.feedback(spark, sf_dir)))


@query
def jaccard_exact(spark, sf_dir):
    return similarity.exact_jaccard(fx.feedback(spark, sf_dir), JACCARD).withColumn("jaccard", F.round("jaccard", 6))


@query
def lsh_similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(fx.feedback(spark, sf_dir), JACCARD).withColumn("jaccard", F.round("jaccard", 6))


@query
def lsh_precision_recall(spark, sf_dir):
    rows = fx.feedback(spark, sf_dir)
    return precision_recall(similarity.similar_pairs(rows, JACCARD).select("a", "b"), similarity.exact_jaccard(rows, JACCARD).select("a", "b"))


@query
def item_means(spark, sf_dir):
    return recommend.item_means(fx.ratings(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query
def item_pearson(spark, sf_dir):
    return recommend.item_correlations(fx.ratings(spark, sf_dir, test=False)).withColumn("corr", F.round("corr", 6))


@query
def cf_neighbors(spark, sf_dir):
    return recommend.neighbour_table(fx.ratings(spark, sf_dir, test=False))


def _cf(spark, sf_dir) -> DataFrame:
    train = fx.ratings(spark, sf_dir, test=False)
    return recommend.predict_ratings(train, fx.ratings(spark, sf_dir, test=True), recommend.neighbour_table(train))


@query
def cf_predict(spark, sf_dir):
    return _cf(spark, sf_dir).withColumn("prediction", F.round("prediction", 6))


@query
def cf_cold_start(spark, sf_dir):
    """Cells whose supplier or customer has no training row: trained on every fortieth order by key, as in the SQL, so most customers have none."""
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    rows = lines.join(orders, "l_orderkey").select("l_orderkey", "user", F.col("l_suppkey").alias("item"), (1 + (F.col("l_quantity").cast("long") - 1) % 5).alias("star"))
    train = rows.where("l_orderkey % 40 = 1").groupBy("user", "item").agg(F.avg("star").alias("stars"))
    found = recommend.predict_ratings(train, rows.select("user", "item"), recommend.neighbour_table(train, 2, 0.2), unknown_item=recommend.UNKNOWN_ITEM)
    users, items = train.select("user").distinct(), train.select("item").distinct()
    cold = found.join(users.withColumn("u", F.lit(1)), "user", "left").join(items.withColumn("i", F.lit(1)), "item", "left").where("u is null or i is null")
    return cold.select("user", "item", F.round("prediction", 6).alias("prediction"))


@query
def cf_rmse(spark, sf_dir):
    return rmse(_cf(spark, sf_dir).join(fx.ratings(spark, sf_dir, test=True), ["user", "item"]), "prediction", "stars")


def _features(spark, sf_dir, test: bool) -> DataFrame:
    train = fx.ratings(spark, sf_dir, test=False)
    cells = fx.ratings(spark, sf_dir, test=True) if test else train
    return recommend.build_features(cells, recommend.user_profiles(train), recommend.item_profiles(train), dense_index(train, "user"), dense_index(train, "item"))


@query
def mb_features(spark, sf_dir):
    rows = _features(spark, sf_dir, test=True)
    return rows.select("user", "item", "user_idx", "item_idx", F.round("user_avg", 6).alias("user_avg"), "user_n", F.round("item_avg", 6).alias("item_avg"), "item_n", F.round("stars", 6).alias("stars"))


def _model_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts have to be written tables."""
    profiles = [materialize(f(train), "profiles") for f in (recommend.user_profiles, recommend.item_profiles)]
    indexes = [dense_index(p.select(c), c) for p, c in zip(profiles, ("user", "item"), strict=True)]
    rows = materialize(recommend.build_features(train, *profiles, *indexes), "features")
    return recommend.predict_regression(recommend.fit_regression(rows), recommend.build_features(test, *profiles, *indexes))


def _parts(spark, sf_dir) -> list[DataFrame]:
    return [materialize(fx.ratings(spark, sf_dir, test=test), "ratings") for test in (False, True)]


@query
def mb_predict(spark, sf_dir):
    return _model_scores(*_parts(spark, sf_dir))


@query
def hybrid_predict(spark, sf_dir):
    """Item-based scores and those of the boosted trees, blended by the published rule; the trees are beyond SQL."""
    train, test = _parts(spark, sf_dir)
    near = materialize(recommend.neighbour_table(train), "neighbours")
    items = materialize(recommend.predict_ratings(train, test, near), "item-scores")
    return recommend.blend(items, _model_scores(train, test))


@query
def hybrid_blend(spark, sf_dir):
    """The blend alone, so that SQL can state it: the mean of both profiles stands in for the model, the cut is one neighbour, as few pairs correlate here."""
    model = _features(spark, sf_dir, test=True).select("user", "item", ((F.col("user_avg") + F.col("item_avg")) / 2).alias("model"))
    return recommend.blend(_cf(spark, sf_dir), model, cut=1).withColumn("prediction", F.round("prediction", 9))


@query
def stream_first_seen(spark, sf_dir):
    return first_seen(fx.user_stream(spark, sf_dir), "user", "seq")


@query
def bloom_fpr(spark, sf_dir):
    return sketches.bloom_false_positives(fx.user_stream(spark, sf_dir), ASK, BLOOM_BITS)


@query
def bloom_fpr_strict(spark, sf_dir):
    return sketches.bloom_false_positives_strict(fx.user_stream(spark, sf_dir), ASK, BLOOM_BITS)


@query
def fm_estimate(spark, sf_dir):
    return sketches.distinct_estimates(fx.user_stream(spark, sf_dir), ASK)


@query
def reservoir_changes(spark, sf_dir):
    return sketches.reservoir_changes(fx.user_stream(spark, sf_dir))


@query
def reservoir_snapshots(spark, sf_dir):
    return sketches.reservoir_snapshots(fx.user_stream(spark, sf_dir))


@query
def graph_vertices(spark, sf_dir):
    return graph.vertices(fx.supplier_graph(spark, sf_dir))


@query
def graph_degrees(spark, sf_dir):
    return graph.degrees(fx.supplier_graph(spark, sf_dir))


@query
def lpa_labels(spark, sf_dir):
    return graph.label_propagation(fx.supplier_graph(spark, sf_dir))


@query
def lpa_communities(spark, sf_dir):
    return graph.communities(graph.label_propagation(fx.nation_graph(spark, sf_dir)))


@query
def connected_components(spark, sf_dir):
    return graph.connected_components(fx.supplier_graph(spark, sf_dir), fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query
def edge_betweenness(spark, sf_dir):
    return graph.edge_betweenness(fx.nation_graph(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 6))


@query
def modularity(spark, sf_dir):
    edges = fx.nation_graph(spark, sf_dir)
    regions = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("label"))
    return graph.modularity(edges, regions).select(F.round("q", 6).alias("q"))


@query
def girvan_newman(spark, sf_dir):
    return graph.girvan_newman(fx.nation_graph(spark, sf_dir)).withColumn("modularity", F.round("modularity", 6))


@query
def bfr_summary(spark, sf_dir):
    rows = cluster.cluster_statistics(fx.points(spark, sf_dir))
    return rows.select("label", "dim", "n", *[F.round(c, 6).alias(c) for c in ("sum", "sumsq", "centroid", "std")])


def _assigned(spark, sf_dir) -> DataFrame:
    rows = fx.points(spark, sf_dir)
    return cluster.assign_nearest(rows, *cluster.Summary.of(cluster.cluster_statistics(rows)))


@query
def bfr_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", "cluster", F.round("distance", 5).alias("distance"))


@query
def bfr_clusters(spark, sf_dir):
    return cluster.bfr(fx.points(spark, sf_dir), clusters=10)[0]


@query
def bfr_rounds(spark, sf_dir):
    return cluster.bfr(fx.points(spark, sf_dir), clusters=10)[1]


@query
def nmi(spark, sf_dir):
    return normalized_mutual_information(_assigned(spark, sf_dir), "label", "cluster")
