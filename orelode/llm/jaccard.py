"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash and MinHash bands for candidates, whole sets to confirm links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import materialize, slabs, small_batches, spread_join, text_hash
from orelode.llm.sieve import key_sieve
from orelode.llm.simhash import _roots, digest_fingerprints, gather, near_links, shingle_digests
from orelode.llm.spans import mix
from orelode.operators.graph import component_roots

#: Bands of ROWS MinHash values. A pair at 0.8 has no band in common with probability (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
#: Of each of the 96 values four bits are carried; candidates agree in so many at least (at 0.8: 78 expected, deviation 3.8).
LEAST = 60
WORDS = [f"s{k}" for k in range(BANDS * ROWS // 16)]
#: Members of a bucket, or of a group of candidates, that one task compares; more are dealt in blocks, each pair of blocks to a task.
BLOCK, GROUP_BLOCK = 1 << 15, 1 << 13
_NIBBLES = np.uint64(0x1111111111111111)


def signatures(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, four bits of each value, packed) of each text's MinHash values over its shingles."""
    return digest_signatures(*shingle_digests(texts, words))


def digest_signatures(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from what :func:`shingle_digests` gives."""
    full = np.nonzero(np.diff(starts))[0]
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.zeros((BANDS * ROWS, len(starts) - 1), dtype=np.uint64)
    for h in range(BANDS * ROWS if len(full) else 0):
        least[h, full] = np.minimum.reduceat((values ^ seeds[2 * h]) * (seeds[2 * h + 1] | np.uint64(1)), starts[full])
    keys = np.empty((BANDS, len(starts) - 1), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts) - 1, band + 1, dtype=np.uint64)
        for row in least[band * ROWS : (band + 1) * ROWS]:
            key = mix(key + row)
        keys[band] = key
    bits, packed = mix(least) >> np.uint64(60), np.zeros((len(WORDS), len(starts) - 1), dtype=np.uint64)
    for h in range(BANDS * ROWS):
        packed[h // 16] |= bits[h] << np.uint64(4 * (h % 16))
    return keys.T, packed.T


def _signature_frames(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text", 250_000):
            values, starts = shingle_digests(part["text"], words)
            keys, packed = digest_signatures(values, starts)
            fp = digest_fingerprints(values, starts)[:, 0].view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "fp": fp, "keys": list(keys.view(np.int64))} | {c: packed[:, k].view(np.int64) for k, c in enumerate(WORDS)})

    return run


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the carried values the signatures (rows of words) agree."""
    x = a ^ b
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _NIBBLES
    return 16 * x.shape[-1] - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _link_bucket(node: np.ndarray, sign: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A forest with the components of all candidate links of a bucket, by search from one member after another."""
    edges, todo = [], np.arange(len(node))
    while len(todo):
        seen, todo = [todo[0]], todo[1:]
        while seen and len(todo):
            x = seen.pop()
            hit = agreement(sign[todo], sign[x]) >= LEAST
            if hit.any():
                edges.append((node[todo[hit]], np.full(hit.sum(), node[x])))
                seen += todo[hit].tolist()
                todo = todo[~hit]
    return edges


def _bucket_links(batches: Iterator[pa.RecordBatch], small: int = 48) -> Iterator[pa.RecordBatch]:
    """For partitions sorted by bucket: star edges with the components of the candidate links of all buckets."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        bucket, pair, node, sign = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.concatenate([[0], np.nonzero((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]))[0] + 1])
        sizes = np.diff(np.append(starts, len(bucket)))
        some = (sizes > 1) & (sizes <= small)
        at, last = np.nonzero(np.repeat(some, sizes))[0], np.repeat((starts + sizes)[some], sizes[some])
        step = 1
        while len(at):
            live = at + step < last
            at, last = at[live], last[live]
            hit = agreement(sign[at], sign[at + step]) >= LEAST
            edges.append((node[at[hit]], node[at[hit] + step]))
            step += 1
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            edges.extend(_link_bucket(node[s : s + n], sign[s : s + n]))
        if edges:
            edges[:] = [_roots(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))]

    for batch in gather(batches):
        bucket, pair, node, *sign = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        rows = bucket, pair, node, np.stack(sign, axis=1).view(np.uint64)
        cut = np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0
        if cut:  # what came before the last bucket is complete
            held.append(tuple(x[:cut] for x in rows))
            flush()
            held = []
        held.append(tuple(x[cut:] for x in rows))
    if sum(len(x[0]) for x in held):
        flush()
    if edges:
        a, b = edges[0]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _dealt(rows: DataFrame, key: str, block: int, most: int) -> DataFrame:
    """``rows`` by ``key``, sorted; a key with over ``block`` rows is dealt in blocks of ``node``, each pair of blocks to a task (``pair``)."""
    if most > block:  # at most (rows / block) keys can be that large
        hot = [(r[key], -(-r["n"] // block)) for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block).collect()]
        if hot:
            sized = rows.join(F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} long, blocks long")), key, "left")
            own = F.expr("pmod(xxhash64(node), blocks)")
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
            rows = sized.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)))
    if "pair" not in rows.columns:
        rows = rows.withColumn("pair", F.lit(-1).cast("long"))
    return rows.repartition(key, "pair").sortWithinPartitions(key, "pair")


def link_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of all pairs of ``sets`` (arrays of distinct values) at ``similarity`` or above; two empty ones link.

    The search goes from one set after another and compares it with all that no tree has yet.
    """
    sizes = np.array([len(s) for s in sets])
    sets_at = np.concatenate([[0], np.cumsum(sizes)])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    left, right, free = [], [], np.ones(len(sets), dtype=bool)
    inside = np.zeros(len(values), dtype=bool)
    rest_at, rest_owners, n_rest = at, owners, len(sets)
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        seen = [first]
        while seen and free.any():
            x = seen.pop()
            if free.sum() < n_rest / 2:
                keep = free[rest_owners]
                rest_at, rest_owners, n_rest = rest_at[keep], rest_owners[keep], int(free.sum())
            own = at[sets_at[x] : sets_at[x + 1]]
            inside[own] = True
            both = np.bincount(rest_owners[inside[rest_at]], minlength=len(sets))
            inside[own] = False
            hit = np.nonzero(free & (both >= similarity * (sizes + sizes[x] - both) - 1e-9))[0]
            if len(hit):
                left.append(hit)
                right.append(np.full(len(hit), x))
                free[hit] = False
                seen += hit.tolist()
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def _set_links(words: int, similarity: float):
    """For partitions sorted by group: edges that connect what pairs of a group at ``similarity`` or above connect."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}

        def links() -> pd.DataFrame:
            nodes = np.fromiter(held, dtype=np.int64, count=len(held))
            a, b = link_sets(list(held.values()), similarity)
            return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

        for frame in frames:
            for part in slabs(iter([frame]), "text"):
                values, starts = shingle_digests(part["text"], words)
                for k, (root, pair, node) in enumerate(zip(part["root"].tolist(), part["pair"].tolist(), part["node"].tolist(), strict=True)):
                    if (root, pair) != now:
                        if len(held) > 1:
                            yield links()
                        now, held = (root, pair), {}
                    held[node] = np.unique(values[starts[k] : starts[k + 1]])
        if len(held) > 1:
            yield links()

    return run


def confirm_groups(docs: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """The groups that links at ``similarity`` or above make within ``groups`` (``doc_id``, ``text_hash`` and a long ``root``).

    Links are told by the exact Jaccard similarity of the sets of shingles; ``component_id`` is the smallest doc_id of a component, and
    ``root`` tells it from others, also where they share that doc_id or have none. Each distinct text is compared once, so copies cost nothing more.
    """
    small_batches(docs.sparkSession)
    table = materialize(groups.select("doc_id", "text_hash", "root"), "groups")
    each = materialize(table.groupBy("root", F.col("text_hash").alias("node")).agg(F.min("doc_id").alias("low")), "group-texts")
    sizes = materialize(each.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").withColumn("many", F.col("n")), "group-sizes")
    members = materialize(spread_join(each, sizes, ["root"], "many"), "members")
    most = members.agg(F.max("n")).first()[0] or 0
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("__key"))
    keyed = keyed.where(key_sieve(members, "node")("__key"))  # other texts needn't be shuffled
    texts = keyed.join(members, (keyed["__key"] == members["node"]) & keyed["doc_id"].eqNullSafe(members["low"])).select("root", "node", "text")
    links = _dealt(texts, "root", GROUP_BLOCK, most).select("root", "pair", "node", "text").mapInPandas(_set_links(words, similarity), "a long, b long")
    roots = component_roots(links, "a", "b").select(F.col("node").alias("text_hash"), "root")
    named = table.drop("root").join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    named = materialize(named, "confirmed")
    lows = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many")), "lows")
    return spread_join(named, lows, ["root"], "many").select("doc_id", "text_hash", "root", "component_id")


def fingerprint_links(each: DataFrame, distance: int) -> DataFrame:
    """Edges ``(a, b)`` that connect texts (``node``, SimHash ``fp``) whose fingerprints are connected within ``distance`` bits; a fingerprint is a node too."""
    fps = materialize(each.groupBy("fp").agg(F.count("*").alias("many")), "distinct-fingerprints")
    near = materialize(near_links(fps, distance), "fingerprint-links")
    linked = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct().withColumn("linked", F.lit(True))
    some = materialize(fps.join(linked, "fp", "left").where("many > 1 or linked").select("fp", "many"), "linked-fingerprints")

    def named(column: str):
        return F.xxhash64(F.lit("fingerprint"), F.col(column))

    stars = spread_join(each.select("node", "fp"), some, ["fp"], "many").select(F.col("node").alias("a"), named("fp").alias("b"))
    return near.select(named("a").alias("a"), named("b").alias("b")).unionAll(stars)


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """``doc_id``, ``text_hash``, ``root`` and ``component_id`` of every row: components of all pairs at ``similarity`` or above.

    Shingles are those of :func:`orelode.llm.simhash.simhash`, as sets. Candidates are texts whose SimHash fingerprints are connected within ``distance``
    bits, and for pairs further apart those that share a band and agree in enough MinHash values; what candidates connect is compared by
    whole sets (:func:`confirm_groups`). The bands are set for 0.8 and above.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    schema = "doc_id long, text_hash long, fp long, keys array<long>, " + ", ".join(f"{c} long" for c in WORDS)
    table = materialize(rows.mapInPandas(_signature_frames(words), schema), "signatures")
    each = table.groupBy(F.col("text_hash").alias("node")).agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), *[F.first(c).alias(c) for c in WORDS])
    each = materialize(each, "distinct-texts")
    entries = each.select(F.explode("keys").alias("bucket"), "node", *WORDS)
    links = _dealt(entries, "bucket", BLOCK, each.count()).select("bucket", "pair", "node", *WORDS).mapInArrow(_bucket_links, "a long, b long")
    roots = component_roots(links.unionAll(fingerprint_links(each, distance)), "a", "b").select(F.col("node").alias("text_hash"), "root")
    groups = table.select("doc_id", "text_hash").join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    return confirm_groups(docs, groups, words, similarity)
