"""Graph operators over edge tables ``(src, dst)``: label propagation, components, betweenness, modularity, Girvan-Newman."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.checkpoint import materialize
from orelode.operators.relational import canonical_pairs, symmetrise

#: Edges that go to every task in per-source searches; larger graphs are searched by joins, level by level.
BROADCAST_EDGES = 500_000


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: edge ends at each vertex, parallel edges counted each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``id, label`` after synchronous rounds in which each vertex takes its neighbours' most frequent label, the smallest of equals."""
    both = materialize(symmetrise(edges), "symmetric")
    labels = both.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        counts = both.join(labels, both["src"] == labels["id"]).groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        # The greatest count, then the smallest label: minimum of (-n, label).
        labels = materialize(counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("id", F.col("best.label").alias("label")), "labels")
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """``label, size, members`` with members sorted and joined by ``', '``, each quoted."""
    groups = labels.groupBy(label).agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("m"))
    return groups.select(label, "size", F.array_join(F.transform("m", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ").alias("members"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def component_roots(edges: DataFrame, a: str = "src", b: str = "dst", most_rounds: int = 200) -> DataFrame:
    """``node, root`` for every node of an edge: root is the smallest node that can be reached.

    Alternating large-star and small-star rounds; rounds grow with the logarithm of the longest path, and each half round is a
    written table, so lineage stays short. Self-loops alone keep their node; an empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now, before = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star"), mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected_components(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """``id, component`` of every vertex, and of the ``id`` in ``isolated`` that no edge names."""
    edges = materialize(edges.select("src", "dst"), "edges")
    ids = vertices(edges) if isolated is None else vertices(edges).union(isolated.select("id")).distinct()
    roots = component_roots(edges)
    return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


def source_credits(adjacency: dict, source) -> Iterator[tuple]:
    """The share of shortest paths from ``source`` that cross each edge, as ``(smaller end, larger end, credit)``.

    ``adjacency`` maps a vertex to ``{neighbour: parallel edges}``; parallel edges count as that many paths.
    """
    level, paths, order, todo = {source: 0}, defaultdict(int, {source: 1}), [], deque([source])
    while todo:
        v = todo.popleft()
        order.append(v)
        for w, n in adjacency[v].items():
            if w not in level:
                level[w] = level[v] + 1
                todo.append(w)
            if level[w] == level[v] + 1:
                paths[w] += paths[v] * n
    credit = dict.fromkeys(order, 1.0)
    for w in reversed(order):
        for v, n in adjacency[w].items():
            if level[v] == level[w] - 1:
                share = credit[w] * paths[v] * n / paths[w]
                credit[v] += share
                yield min(v, w), max(v, w), share


def _adjacency(edges: Iterable[tuple]) -> dict:
    found: dict = defaultdict(lambda: defaultdict(int))
    for a, b in edges:
        if a != b:
            found[a][b] += 1
            found[b][a] += 1
    return {v: dict(w) for v, w in found.items()}


def _levels(edges: DataFrame) -> DataFrame:
    """Betweenness by joins keyed by (source, node): forward for path counts, backward for credits."""
    weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = materialize(weighted.unionAll(weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")), "weighted")
    frontier = vertices(edges).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("paths"))
    seen = levels = materialize(frontier, "level")
    stack = [levels]
    while True:
        reach = levels.join(both, levels["v"] == both["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("paths") * F.col("n")).alias("paths"))
        levels = materialize(reach.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(len(stack)).alias("level"), "paths"), "level")
        if levels.isEmpty():
            break
        stack.append(levels)
        seen = seen.unionAll(levels)
    credits, flows = None, []
    for low in range(len(stack) - 1, 0, -1):
        child = stack[low].withColumn("credit", F.lit(1.0))
        if credits is not None:
            child = stack[low].join(credits, ["s", "v"], "left").select("s", "v", "paths", (F.coalesce("credit", F.lit(0.0)) + 1.0).alias("credit"))
        parents = stack[low - 1].select(F.col("s").alias("ps"), F.col("v").alias("pv"), F.col("paths").alias("pp"))
        met = child.join(both, child["v"] == both["src"]).join(parents, (F.col("s") == F.col("ps")) & (F.col("dst") == F.col("pv")))
        flow = materialize(met.select("s", "v", F.col("pv").alias("p"), (F.col("credit") * F.col("pp") * F.col("n") / F.col("paths")).alias("share")), "flow")
        flows.append(flow.select(F.least("v", "p").alias("src"), F.greatest("v", "p").alias("dst"), "share"))
        credits = flow.groupBy("s", F.col("p").alias("v")).agg(F.sum("share").alias("credit"))
    out = flows[0]
    for flow in flows[1:]:
        out = out.unionAll(flow)
    return out


def edge_betweenness(edges: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``src, dst, betweenness``: over all pairs of vertices, the share of shortest paths that cross the edge.

    Up to ``broadcast_edges`` edges, each task searches from its share of the sources over the whole graph; beyond, the
    searches run as joins.
    """
    pairs = canonical_pairs(edges).where("src <> dst")
    kind = dict(pairs.dtypes)["src"]
    if pairs.isEmpty():
        return pairs.select("src", "dst", F.lit(0.0).alias("betweenness"))
    known = pairs.limit(broadcast_edges + 1).collect()
    if len(known) <= broadcast_edges:
        graph = [(r["src"], r["dst"]) for r in known]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            adjacency, total = _adjacency(graph), defaultdict(float)
            for frame in frames:
                for source in frame["id"].tolist():
                    for a, b, share in source_credits(adjacency, source):
                        total[a, b] += share
            yield pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["src", "dst", "share"])

        flows = vertices(pairs).repartition(F.col("id")).mapInPandas(run, f"src {kind}, dst {kind}, share double")
    else:
        flows = _levels(pairs)
    return flows.groupBy("src", "dst").agg((F.sum("share") / 2).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``q`` of the partition ``labels (id, label)``: sum over communities of e / 2m - (d / 2m)^2.

    m counts rows of ``edges``, d sums degrees, e counts ordered pairs of neighbours within a community, parallel edges once.
    """
    m2 = edges.agg((2 * F.count("*")).alias("m2"))
    volume = degrees(edges).join(labels, "id").groupBy("label").agg(F.sum("degree").alias("d"))
    pairs = canonical_pairs(edges).where("src <> dst").distinct()
    inside = pairs.join(labels.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst").where("x = y")
    both = inside.groupBy(F.col("x").alias("label")).agg((2 * F.count("*")).alias("e"))
    met = volume.join(both, "label", "left").join(F.broadcast(m2))
    return met.agg(F.sum(F.coalesce("e", F.lit(0)) / F.col("m2") - F.pow(F.col("d") / F.col("m2"), 2)).alias("q"))


def _components(adjacency: dict) -> list[frozenset]:
    left, out = set(adjacency), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            v = todo.pop()
            seen.add(v)
            for w in adjacency[v]:
                if w in left:
                    left.discard(w)
                    todo.append(w)
        out.append(frozenset(seen))
    return out


def girvan_newman(edges: DataFrame, most_edges: int = 20_000) -> DataFrame:
    """``id, community, modularity``: cut the edge of greatest betweenness (of equals the smallest) until no edge is left; the best cut wins.

    Every removal changes all shortest paths of its component, so the method takes as many rounds as edges and is for graphs
    up to ``most_edges`` (an error beyond). Only the component that lost an edge is searched again. Of equally good partitions the
    later one wins; the graph before the first cut isn't scored. ``community`` is the smallest member.
    """
    rows = canonical_pairs(edges).limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"over {most_edges} edges: use label_propagation or connected_components")
    graph = [(r["src"], r["dst"]) for r in rows]
    kind = dict(canonical_pairs(edges).dtypes)["src"]
    degree: dict = defaultdict(int)
    for a, b in graph:
        degree[a] += 1
        degree[b] += 1
    original, now, m2 = _adjacency(graph), _adjacency(graph), 2 * len(graph)
    for v in degree:
        original.setdefault(v, {})
        now.setdefault(v, {})

    def score(parts: Iterable[frozenset]) -> float:
        return sum(sum(w in part for v in part for w in original[v]) / m2 - (sum(degree[v] for v in part) / m2) ** 2 for part in parts)

    def between(part: Iterable) -> dict:
        total: dict = defaultdict(float)
        for source in part:
            for a, b, share in source_credits(now, source):
                total[a, b] += share / 2
        return total

    parts = {c: between(c) for c in _components(now)}
    best: tuple[float, list[frozenset]] | None = None
    while any(parts.values()):
        part, (a, b) = min(((c, e) for c, values in parts.items() for e in values), key=lambda x: (-round(parts[x[0]][x[1]], 9), x[1]))
        del now[a][b], now[b][a]
        del parts[part]
        for piece in _components({v: now[v] for v in part}):
            parts[piece] = between(piece)
        q = score(parts)
        if best is None or q >= best[0] - 1e-12:
            best = (q, list(parts))
    if best is None:
        best = (score(parts) if m2 else 0.0, list(parts))
    out = [(v, min(part), float(best[0])) for part in best[1] for v in part]
    return edges.sparkSession.createDataFrame(out, f"id {kind}, community {kind}, modularity double")
