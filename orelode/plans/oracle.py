"""DuckDB SQL for the registered queries, from the same tables."""

from __future__ import annotations

from orelode.functions.hashing import MULTIPLIERS, OFFSET
from orelode.plans.queries import ASK, BLOOM_BITS, JACCARD
from orelode.operators.sketches import BLOOM_MULTIPLIERS

_BASKETS = """
pairs_of AS (SELECT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
large AS (SELECT basket_id FROM pairs_of GROUP BY 1 HAVING count(*) > 4),
baskets AS (SELECT DISTINCT basket_id, item FROM pairs_of WHERE basket_id IN (SELECT basket_id FROM large)),
s AS (SELECT greatest(2, count(DISTINCT basket_id) // 100) AS s FROM baskets)"""

_F1 = "f1 AS (SELECT item, count(*) AS support FROM baskets GROUP BY 1 HAVING count(*) >= (SELECT s FROM s))"
_F2 = """f2 AS (SELECT x.item AS i1, y.item AS i2, count(*) AS support FROM baskets x JOIN baskets y ON x.basket_id = y.basket_id AND x.item < y.item
GROUP BY 1, 2 HAVING count(*) >= (SELECT s FROM s))"""
_F3 = """f3 AS (SELECT x.item AS i1, y.item AS i2, z.item AS i3, count(*) AS support FROM baskets x JOIN baskets y ON x.basket_id = y.basket_id AND x.item < y.item
JOIN baskets z ON y.basket_id = z.basket_id AND y.item < z.item GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT s FROM s))"""
_F4 = """f4 AS (SELECT x.item AS i1, y.item AS i2, z.item AS i3, w.item AS i4, count(*) AS support FROM baskets x JOIN baskets y ON x.basket_id = y.basket_id AND x.item < y.item
JOIN baskets z ON y.basket_id = z.basket_id AND y.item < z.item JOIN baskets w ON z.basket_id = w.basket_id AND z.item < w.item GROUP BY 1, 2, 3, 4 HAVING count(*) >= (SELECT s FROM s))"""
_F5 = """f5 AS (SELECT v.item AS i1, x.item AS i2, y.item AS i3, z.item AS i4, w.item AS i5, count(*) AS support FROM baskets v JOIN baskets x ON v.basket_id = x.basket_id AND v.item < x.item
JOIN baskets y ON x.basket_id = y.basket_id AND x.item < y.item JOIN baskets z ON y.basket_id = z.basket_id AND y.item < z.item JOIN baskets w ON z.basket_id = w.basket_id AND z.item < w.item
GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= (SELECT s FROM s))"""
_ALL = f"""WITH {_BASKETS}, {_F1}, {_F2}, {_F3}, {_F4}, {_F5}
SELECT 1 AS size, item AS itemset, support FROM f1 UNION ALL SELECT 2, i1 || ',' || i2, support FROM f2
UNION ALL SELECT 3, i1 || ',' || i2 || ',' || i3, support FROM f3 UNION ALL SELECT 4, concat_ws(',', i1, i2, i3, i4), support FROM f4
UNION ALL SELECT 5, concat_ws(',', i1, i2, i3, i4, i5), support FROM f5"""

_FEEDBACK = "inc AS (SELECT DISTINCT l_suppkey AS item, o_custkey AS member FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_INDEX = "idx AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS idx FROM (SELECT DISTINCT member FROM inc)), n AS (SELECT count(*) AS n FROM idx)"
_SIG = "sig AS (SELECT item, " + ", ".join(f"min(({p} * idx + {OFFSET}) % (SELECT n FROM n)) AS m{i}" for i, p in enumerate(MULTIPLIERS)) + " FROM inc JOIN idx USING (member) GROUP BY item)"
_BANDS = "bands AS (" + " UNION ALL ".join(f"SELECT item, {b} AS band, m{2 * b} AS h1, m{2 * b + 1} AS h2 FROM sig" for b in range(len(MULTIPLIERS) // 2)) + ")"
_CAND = "cand AS (SELECT DISTINCT x.item AS a, y.item AS b FROM bands x JOIN bands y USING (band, h1, h2) WHERE x.item < y.item)"
_JACCARD = f"""sizes AS (SELECT item, count(*) AS n FROM inc GROUP BY 1),
both_ AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM inc x JOIN inc y USING (member) WHERE x.item < y.item GROUP BY 1, 2),
jac AS (SELECT a, b, b2.n / (x.n + y.n - b2.n)::DOUBLE AS jaccard FROM both_ b2 JOIN sizes x ON x.item = a JOIN sizes y ON y.item = b),
truth AS (SELECT * FROM jac WHERE jaccard >= {JACCARD})"""
_LSH = f"WITH {_FEEDBACK}, {_INDEX}, {_SIG}, {_BANDS}, {_CAND}, {_JACCARD}"


def _ratings(name: str, where: str) -> str:
    return f"{name} AS (SELECT o_custkey AS user_, l_suppkey AS item, avg(1 + (l_quantity::BIGINT - 1) % 5) AS stars FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {where} GROUP BY 1, 2)"


_TRAIN, _TEST = _ratings("train", "l_orderkey % 5 <> 0"), _ratings("test", "l_orderkey % 5 = 0")


def _cf(min_co_raters: int = 25) -> str:
    return f"""means AS (SELECT item, avg(stars) AS mean, count(*) AS n FROM train GROUP BY 1),
dev AS (SELECT user_, t.item, stars - mean AS d FROM train t JOIN means USING (item)),
pear AS (SELECT x.item AS a, y.item AS b, count(*) AS n, sum(x.d * y.d) AS xy, sqrt(sum(x.d * x.d)) * sqrt(sum(y.d * y.d)) AS den
  FROM dev x JOIN dev y USING (user_) WHERE x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {min_co_raters}),
corrs AS (SELECT a, b, n, CASE WHEN den = 0 THEN 0.0 ELSE xy / den END AS corr FROM pear),
near AS (SELECT a AS item, b AS neighbour, round(corr, 6) AS corr FROM corrs WHERE round(corr, 6) >= 0.2
  UNION ALL SELECT b, a, round(corr, 6) FROM corrs WHERE round(corr, 6) >= 0.2)"""


_PREDICT = """cells AS (SELECT DISTINCT user_, item FROM test),
rated AS (SELECT c.user_, c.item, neighbour, corr, t.stars, count(*) OVER (PARTITION BY c.user_, c.item) AS n_neighbours,
  row_number() OVER (PARTITION BY c.user_, c.item ORDER BY corr DESC, neighbour DESC) AS k
  FROM cells c JOIN near USING (item) JOIN train t ON t.user_ = c.user_ AND t.item = neighbour),
score AS (SELECT user_, item, CASE WHEN sum(abs(corr)) = 0 THEN 0.0 ELSE sum(corr * stars) / sum(abs(corr)) END AS w, max(n_neighbours) AS n_neighbours FROM rated WHERE k <= 30 GROUP BY 1, 2),
pred AS (SELECT c.user_, c.item, CASE WHEN mean IS NULL THEN 4.0 WHEN w IS NULL THEN mean ELSE greatest(0.0, least(5.0, w)) END AS prediction, coalesce(n_neighbours, 0) AS n_neighbours
  FROM cells c LEFT JOIN means USING (item) LEFT JOIN score s ON s.user_ = c.user_ AND s.item = c.item)"""
_CF = f"WITH {_TRAIN}, {_TEST}, {_cf()}, {_PREDICT}"
_PROFILES = """ups AS (SELECT user_, avg(stars) AS user_avg, count(*) AS user_n FROM train GROUP BY 1),
ips AS (SELECT item, avg(stars) AS item_avg, count(*) AS item_n FROM train GROUP BY 1),
ui AS (SELECT user_, row_number() OVER (ORDER BY user_) - 1 AS user_idx FROM (SELECT DISTINCT user_ FROM train)),
ii AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS item_idx FROM (SELECT DISTINCT item FROM train)),
feats AS (SELECT t.user_, t.item, stars, coalesce(user_idx, -1) AS user_idx, coalesce(item_idx, -1) AS item_idx, coalesce(user_avg, 0) AS user_avg, coalesce(user_n, 0) AS user_n,
  coalesce(item_avg, 0) AS item_avg, coalesce(item_n, 0) AS item_n FROM test t LEFT JOIN ui USING (user_) LEFT JOIN ii ON ii.item = t.item LEFT JOIN ups ON ups.user_ = t.user_ LEFT JOIN ips ON ips.item = t.item)"""


def _residue(modulus: int) -> str:
    return f"list_reduce(list_concat([0::BIGINT], list_transform(range(1, length(u) + 1), lambda i: ascii(substr(u, i, 1))::BIGINT)), lambda a, b: (a * 256 + b) % {modulus})"


_STREAM = "stream AS (SELECT event_id AS seq, user_id::VARCHAR AS u FROM events)"
#: The least prime not below 2.8 times an ask of 100 (fixed value, so that the code under test doesn't supply it).
_FM_MODULUS = 281
assert ASK == 100


def _zeros(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN -1 ELSE bit_count(({x} & -({x})) - 1) END"


def _fm() -> str:
    most = ", ".join(f"max({_zeros(f'(({p} * s + {OFFSET}) % {_FM_MODULUS})')}) AS r{i}" for i, p in enumerate(MULTIPLIERS))
    means = [f"floor(({' + '.join(f'CASE WHEN r{i} < 0 THEN 1.0 ELSE pow(2.0, r{i}) END' for i in range(g * 8, g * 8 + 8))}) / 8)" for g in range(3)]
    return f"""WITH {_STREAM}, per AS (SELECT DISTINCT seq // {ASK} AS ask, u, {_residue(_FM_MODULUS)} AS s FROM stream),
r AS (SELECT ask, count(*) AS truth, {most} FROM per GROUP BY 1)
SELECT ask, truth, floor(list_sort([{', '.join(means)}])[2])::BIGINT AS estimate FROM r"""


def _bloom() -> str:
    bits = " UNION ALL ".join(f"SELECT u, first, ({p} * s + {OFFSET}) % {BLOOM_BITS} AS bit FROM users" for p in BLOOM_MULTIPLIERS)
    return f"""WITH {_STREAM}, users AS (SELECT u, min(seq) AS first, {_residue(BLOOM_BITS)} AS s FROM stream GROUP BY u),
own AS ({bits}), since AS (SELECT bit, min(first) AS since FROM own GROUP BY 1),
state AS (SELECT u, first, max(since) AS latest, min(since) AS earliest FROM own JOIN since USING (bit) GROUP BY 1, 2),
counts AS (SELECT first // {ASK} AS ask, sum((latest < first)::INT)::BIGINT AS fp, sum((earliest = first)::INT)::BIGINT AS tn FROM state GROUP BY 1),
asks AS (SELECT DISTINCT seq // {ASK} AS ask FROM stream)
SELECT ask, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 6) AS fpr FROM asks LEFT JOIN counts USING (ask)"""


def _bloom_strict() -> str:
    own = ", ".join(f"({p} * s + {OFFSET}) % {BLOOM_BITS}" for p in BLOOM_MULTIPLIERS)
    return f"""WITH RECURSIVE {_STREAM}, users AS (SELECT u, min(seq) AS first, {_residue(BLOOM_BITS)} AS s FROM stream GROUP BY u),
ordered AS (SELECT row_number() OVER (ORDER BY min(first)) AS k, min(first) AS first, [{own}] AS own FROM users GROUP BY s),
fold(k, bits, inserted) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL
  SELECT o.k, CASE WHEN list_has_any(bits, own) THEN bits ELSE list_concat(bits, own) END, NOT list_has_any(bits, own) FROM fold JOIN ordered o ON o.k = fold.k + 1),
since AS (SELECT DISTINCT unnest(own) AS bit, first AS since FROM fold JOIN ordered USING (k) WHERE inserted),
each_bit AS (SELECT u, first, unnest([{own}]) AS bit FROM users),
state AS (SELECT u, first, bool_and(coalesce(since < first, false)) AS is_fp, NOT bool_or(coalesce(since < first, false)) AS is_tn FROM each_bit LEFT JOIN since USING (bit) GROUP BY 1, 2),
counts AS (SELECT first // {ASK} AS ask, sum(is_fp::INT)::BIGINT AS fp, sum(is_tn::INT)::BIGINT AS tn FROM state GROUP BY 1),
asks AS (SELECT DISTINCT seq // {ASK} AS ask FROM stream)
SELECT ask, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 6) AS fpr FROM asks LEFT JOIN counts USING (ask)"""


def _uniform(salt: str) -> str:
    return f"('0x' || substr(md5('{salt}:' || seq::VARCHAR), 1, 12))::BIGINT"


_CHANGES = f"""changes AS (SELECT CASE WHEN seq < 100 THEN seq ELSE {_uniform('slot')} % 100 END AS slot, seq, u FROM stream
WHERE seq < 100 OR {_uniform('keep')} % (seq + 1) < 100)"""
_SNAPSHOTS = f"""WITH {_STREAM}, {_CHANGES}, asks AS (SELECT (seq // {ASK} + 1) * {ASK} AS seqnum FROM stream GROUP BY 1 HAVING count(*) = {ASK})
SELECT seqnum, """ + ", ".join(f"(SELECT max_by(u, seq) FROM changes WHERE slot = {s} AND seq < seqnum) AS id_{s}" for s in (0, 20, 40, 60, 80)) + " FROM asks"


def _heavy(name: str, pairs: str, share: float) -> str:
    return f"""{name}_w AS (SELECT src, dst, count(*) AS w FROM ({pairs}) GROUP BY 1, 2),
{name} AS (SELECT src, dst FROM {name}_w WHERE w >= (SELECT quantile_disc(w, {share}) FROM {name}_w))"""


_NATIONS = _heavy("g", "SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey", 0.8)
_SUPPLIERS = "ls AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), " + _heavy("g", "SELECT x.l_suppkey AS src, y.l_suppkey AS dst FROM ls x JOIN ls y USING (l_orderkey) WHERE x.l_suppkey < y.l_suppkey", 0.95)
_BOTH = "both_ AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), v AS (SELECT DISTINCT src AS id FROM both_)"


def _lpa(graph: str) -> str:
    steps = ["l0 AS (SELECT id, id AS label FROM v)"]
    for k in range(1, 6):
        steps.append(f"l{k} AS (SELECT id, label FROM (SELECT dst AS id, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS k FROM both_ JOIN l{k - 1} ON l{k - 1}.id = src GROUP BY dst, label) WHERE k = 1)")
    return f"WITH {graph}, {_BOTH}, {', '.join(steps)}"


_BETWEENNESS = f"""WITH RECURSIVE {_NATIONS}, {_BOTH},
walk(s, v, len, seen) AS (SELECT id, id, 0, [id] FROM v UNION ALL SELECT s, dst, len + 1, list_append(seen, dst) FROM walk JOIN both_ ON src = walk.v WHERE len < 6 AND NOT list_contains(seen, dst)),
dist AS (SELECT s, v, min(len) AS d FROM walk GROUP BY 1, 2),
sig AS (SELECT w.s, w.v, d, count(*) AS n FROM walk w JOIN dist USING (s, v) WHERE len = d GROUP BY 1, 2, 3)
SELECT g.src, g.dst, round(sum(a.n * b.n / st.n::DOUBLE), 6) AS betweenness FROM g
JOIN sig st ON st.s <> st.v JOIN sig a ON a.s = st.s AND a.v = g.src JOIN sig b ON b.s = st.v AND b.v = g.dst
WHERE a.d + 1 + b.d = st.d GROUP BY 1, 2"""

_LONG = "long AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
_STATS = "stats AS (SELECT label, dim, count(*) AS n, sum(x) AS sum_, sum(x * x) AS sumsq, sum(x) / count(*) AS centroid, sqrt(greatest(0.0, sum(x * x) / count(*) - (sum(x) / count(*)) ** 2)) AS std FROM long GROUP BY 1, 2)"
_ASSIGN = "near AS (SELECT l.id, l.label AS truth, s.label AS cluster, sqrt(sum(((x - centroid) / greatest(std, 1e-9)) ** 2)) AS distance FROM long l JOIN stats s USING (dim) GROUP BY 1, 2, 3), best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "baskets": f"WITH {_BASKETS} SELECT * FROM baskets",
        "freq_singletons": f"WITH {_BASKETS}, {_F1} SELECT item AS itemset, support FROM f1",
        "freq_pairs": f"WITH {_BASKETS}, {_F2} SELECT i1 || ',' || i2 AS itemset, support FROM f2",
        "freq_triples": f"WITH {_BASKETS}, {_F3} SELECT concat_ws(',', i1, i2, i3) AS itemset, support FROM f3",
        "freq_itemsets": _ALL,
        "freq_itemsets_fp": _ALL,
        "itemset_candidates": f"WITH {_BASKETS}, {_F2} SELECT concat_ws(',', x.i1, x.i2, y.i2) AS itemset FROM f2 x JOIN f2 y ON x.i1 = y.i1 AND x.i2 < y.i2 JOIN f2 z ON z.i1 = x.i2 AND z.i2 = y.i2",
        "itemset_report": f"WITH {_BASKETS}, {_F1}, {_F2} SELECT 1 AS size, '(''' || item || ''')' AS line FROM f1 UNION ALL SELECT 2, '(''' || i1 || ''', ''' || i2 || ''')' FROM f2",
        "pcy_buckets": f"""WITH {_BASKETS}, coded AS (SELECT basket_id, item, regexp_extract(item, '[0-9]+')::BIGINT AS code FROM baskets)
SELECT (x.code + y.code) % 10000 AS bucket, count(*) AS n FROM coded x JOIN coded y ON x.basket_id = y.basket_id AND x.item < y.item GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)""",
        "dense_user_index": f"WITH {_FEEDBACK}, {_INDEX} SELECT member, idx FROM idx",
        "minhash_signatures": f"{_LSH} SELECT item, concat_ws(',', {', '.join(f'm{i}' for i in range(24))}) AS sig FROM sig",
        "lsh_candidates": f"{_LSH} SELECT a, b FROM cand",
        "jaccard_exact": f"WITH {_FEEDBACK}, {_JACCARD} SELECT a, b, round(jaccard, 6) AS jaccard FROM truth",
        "lsh_similar_pairs": f"{_LSH} SELECT a, b, round(jaccard, 6) AS jaccard FROM truth JOIN cand USING (a, b)",
        "lsh_precision_recall": f"""{_LSH}, found AS (SELECT a, b FROM truth JOIN cand USING (a, b)),
n3 AS (SELECT (SELECT count(*) FROM found) AS n_found, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM truth JOIN found USING (a, b)) AS n_both)
SELECT n_found, n_truth, n_both, round(n_both / nullif(n_found, 0), 6) AS precision, round(n_both / nullif(n_truth, 0), 6) AS recall FROM n3""",
        "item_means": f"WITH {_ratings('r', 'true')} SELECT item, round(avg(stars), 6) AS mean, count(*) AS n FROM r GROUP BY 1",
        "item_pearson": f"WITH {_TRAIN}, {_cf()} SELECT a, b, n, round(corr, 6) AS corr FROM corrs",
        "cf_neighbors": f"WITH {_TRAIN}, {_cf()} SELECT item, neighbour, corr FROM near",
        "cf_predict": f'{_CF} SELECT user_ AS "user", item, round(prediction, 6) AS prediction, n_neighbours FROM pred',
        "cf_cold_start": f"""WITH {_ratings('train', 'l_orderkey % 40 = 1')}, {_ratings('test', 'true')}, {_cf(2)}, {_PREDICT}
SELECT user_ AS "user", item, round(prediction, 6) AS prediction FROM pred WHERE user_ NOT IN (SELECT user_ FROM train) OR item NOT IN (SELECT item FROM train)""",
        "cf_rmse": f"{_CF} SELECT count(*) AS n, round(sqrt(avg((prediction - stars) ** 2)), 6) AS rmse FROM pred JOIN test USING (user_, item)",
        "mb_features": f'WITH {_TRAIN}, {_TEST}, {_PROFILES} SELECT user_ AS "user", item, user_idx, item_idx, round(user_avg, 6) AS user_avg, user_n, round(item_avg, 6) AS item_avg, item_n, round(stars, 6) AS stars FROM feats',
        "hybrid_blend": f"""{_CF}, {_PROFILES} SELECT p.user_ AS "user", p.item, round(CASE WHEN n_neighbours > 1 THEN 0.9 * prediction + (1 - 0.9) * (user_avg + item_avg) / 2
ELSE 0.1 * prediction + (1 - 0.1) * (user_avg + item_avg) / 2 END, 9) AS prediction FROM pred p JOIN feats f ON f.user_ = p.user_ AND f.item = p.item""",
        "stream_first_seen": f'WITH {_STREAM} SELECT u AS "user", min(seq) AS first FROM stream GROUP BY 1',
        "bloom_fpr": _bloom(),
        "bloom_fpr_strict": _bloom_strict(),
        "fm_estimate": _fm(),
        "reservoir_changes": f'WITH {_STREAM}, {_CHANGES} SELECT slot, seq, u AS "user" FROM changes',
        "reservoir_snapshots": _SNAPSHOTS,
        "graph_vertices": f"WITH {_SUPPLIERS}, {_BOTH} SELECT id FROM v",
        "graph_degrees": f"WITH {_SUPPLIERS} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY 1",
        "lpa_labels": f"{_lpa(_SUPPLIERS)} SELECT id, label FROM l5",
        "lpa_communities": f"{_lpa(_NATIONS)} SELECT label, count(*) AS size, string_agg('''' || id || '''', ', ' ORDER BY id::VARCHAR) AS members FROM l5 GROUP BY 1",
        "connected_components": f"""WITH RECURSIVE {_SUPPLIERS}, {_BOTH}, ids AS (SELECT id FROM v UNION SELECT s_suppkey FROM supplier),
reach(id, root) AS (SELECT id, id FROM ids UNION SELECT dst, root FROM reach JOIN both_ ON src = reach.id) SELECT id, min(root) AS component FROM reach GROUP BY 1""",
        "edge_betweenness": _BETWEENNESS,
        "modularity": f"""WITH {_NATIONS}, lab AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS label FROM nation), m AS (SELECT 2.0 * count(*) AS m2 FROM g),
d AS (SELECT label, count(*) AS d FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) JOIN lab USING (id) GROUP BY 1),
e AS (SELECT x.label, 2 * count(*) AS e FROM g JOIN lab x ON x.id = src JOIN lab y ON y.id = dst WHERE x.label = y.label GROUP BY 1)
SELECT round(sum(coalesce(e, 0) / m2 - (d / m2) ** 2), 6) AS q FROM d LEFT JOIN e USING (label), m""",
        "bfr_summary": f"WITH {_LONG}, {_STATS} SELECT label, dim, n, round(sum_, 6) AS sum, round(sumsq, 6) AS sumsq, round(centroid, 6) AS centroid, round(std, 6) AS std FROM stats",
        "bfr_assign": f"WITH {_LONG}, {_STATS}, {_ASSIGN} SELECT id, cluster, round(distance, 5) AS distance FROM best",
        "nmi": f"""WITH {_LONG}, {_STATS}, {_ASSIGN}, c AS (SELECT truth, cluster, count(*) AS c FROM best GROUP BY 1, 2), n AS (SELECT sum(c)::BIGINT AS n FROM c),
a AS (SELECT sum(c) AS c FROM c GROUP BY truth), b AS (SELECT sum(c) AS c FROM c GROUP BY cluster),
h AS (SELECT (SELECT -sum(c / n * ln(c / n)) FROM a, n) AS ht, (SELECT -sum(c / n * ln(c / n)) FROM b, n) AS hf, (SELECT -sum(c / n * ln(c / n)) FROM c, n) AS hc)
SELECT n, round(CASE WHEN ht + hf = 0 THEN 1.0 ELSE 2 * (ht + hf - hc) / (ht + hf) END, 6) AS nmi FROM h, n""",
    }
