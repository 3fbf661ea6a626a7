"""SimHash near-duplicates by multi-index hashing: small Hamming balls in each segment, table matches, full distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import materialize, release_memory, slabs, small_batches, spread_join, text_hash
from orelode.llm.sieve import key_sieve, record_digest
from orelode.llm.spans import mix
from orelode.operators.graph import component_roots

SEED = 42
#: What scrambles the digests of further tables.
SALT = 0xD6E8FEB86659FD93
BITS = 64
#: Members of a bucket that one task compares; a larger bucket is dealt in blocks, each pair of blocks to a task.
BLOCK = 1 << 17
#: Up to so many fingerprints are compared directly; more are first parted by finer segments.
DIRECT = 2048


def shingle_digests(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all texts' shingles in one array (uint64), and where each text starts (one more entry: the end)."""
    digest, hashes, starts = xxhash.xxh64_intdigest, [], [0]
    for text in texts:
        parts = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if len(parts) > words:
            whole, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
            begins = [0, *ends[: len(parts) - words].tolist()]
            hashes += [digest(whole[a:b], SEED) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)]
        elif parts:
            hashes.append(digest(b" ".join(parts), SEED))
        starts.append(len(hashes))
    return np.array(hashes, dtype=np.uint64), np.array(starts)


def fingerprints(texts, words: int, tables: int = 1) -> np.ndarray:
    """The 64-bit SimHashes of each text (uint64, a column for each table): see :func:`simhash`."""
    return digest_fingerprints(*shingle_digests(texts, words), tables)


def digest_fingerprints(values: np.ndarray, starts: np.ndarray, tables: int = 1) -> np.ndarray:
    """The same from what :func:`shingle_digests` gives."""
    out = np.zeros((len(starts) - 1, tables), dtype=np.uint64)
    sizes = np.diff(starts)
    full = np.nonzero(sizes)[0]
    for t in range(tables if len(full) else 0):
        own = mix(values ^ np.uint64(t * SALT & (1 << 64) - 1)) if t else values
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
        out[full, t] = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _names(tables: int) -> list[str]:
    return ["fp", *(f"fp{t}" for t in range(1, tables))]


def _fingerprint_frames(words: int, tables: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            found = fingerprints(part["text"], words, tables).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"]} | {c: found[:, t] for t, c in enumerate(_names(tables))})

    return run


def simhash(docs: DataFrame, words: int = 4, tables: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the fingerprint as a signed long; ``fp1`` ... of further tables) of every row.

    A-Z are lower-cased, words are runs between ASCII white space, shingles are ``words`` words (repeats
    count; a shorter text is one shingle of all its words). A bit is 1 if it is set in over half of the
    shingles' XXH64; further tables scramble those digests. A null text, or one without words, has fingerprint 0. Only
    ``doc_id`` and ``text`` are read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return rows.mapInPandas(_fingerprint_frames(words, tables), "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in _names(tables)))


class Segments:
    """How fingerprints are parted: widths that sum to 64 and radii with sum(radius + 1) = distance + 1.

    If two fingerprints differ in at most ``distance`` bits, then in some segment they differ in at most its radius.
    """

    def __init__(self, distance: int, parts: int):
        self.distance, parts = distance, min(parts, distance + 1)
        self.widths = [BITS // parts + (i < BITS % parts) for i in range(parts)]
        total = distance + 1 - parts
        self.radii = [total // parts + (i >= parts - total % parts) for i in range(parts)]  # the larger radii at the narrower segments
        self.shifts = np.concatenate([[0], np.cumsum(self.widths)[:-1]]).astype(int).tolist()
        self.masks = [np.array([sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)], dtype=np.uint64) for width, radius in zip(self.widths, self.radii, strict=True)]

    @classmethod
    def for_count(cls, distance: int, n: int) -> Segments:
        """As many segments as keep a table's expected matches under 16: fewer are more selective, but need larger balls."""
        parts = next((m for m in range(max(2, distance), 1, -1) if n / 2 ** (BITS / m) <= 16), 2)
        return cls(distance, parts)

    def entries(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, fingerprint, probe): each fingerprint once in each segment's table, and as probes in its ball.

        Of two segment values that differ, only the smaller probes for the larger, so a pair meets once in a segment.
        """
        buckets, owners, probes = [], [], []
        for i, (shift, width, masks) in enumerate(zip(self.shifts, self.widths, self.masks, strict=True)):
            value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            tag = np.uint64(i << 58)
            buckets.append(value | tag)
            owners.append(fps)
            probes.append(np.zeros(len(fps), dtype=bool))
            if len(masks):
                near = value[:, None] ^ masks[None, :]
                row, col = np.nonzero(near > value[:, None])
                buckets.append(near[row, col] | tag)
                owners.append(fps[row])
                probes.append(np.ones(len(row), dtype=bool))
        return np.concatenate(buckets), np.concatenate(owners), np.concatenate(probes)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the edges (a, b) connect: each node but the smallest, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _reach(table: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of all links table-table and probe-table, by search from one after another."""
    left, right = [], []
    todo, waiting = table, probes
    while len(todo):
        seen = [todo[:1]]
        todo = todo[1:]
        while seen:
            frontier = seen.pop()
            for x in frontier:
                if not len(todo) and not len(waiting):
                    break
                hit = np.bitwise_count(todo ^ x) <= distance
                if hit.any():
                    left.append(todo[hit])
                    right.append(np.full(hit.sum(), x))
                    seen.append(todo[hit])
                    todo = todo[~hit]
                hit = np.bitwise_count(waiting ^ x) <= distance
                if hit.any():  # a probe may belong to several trees: it joins them, so it stays
                    left.append(waiting[hit])
                    right.append(np.full(hit.sum(), x))
    if not left:
        return table[:0], table[:0]
    return np.concatenate(left), np.concatenate(right)


def link_bucket(table: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between table entries, and between probes and table entries, with the components of all links."""
    if len(table) <= DIRECT or len(table) + len(probes) < 2 * DIRECT:
        return _roots(*_reach(table, probes, distance))
    edges, parts = [], distance + 1
    for i in range(parts):  # of distance + 1 segments one is equal
        shift, end = BITS * i // parts, BITS * (i + 1) // parts
        mask = np.uint64((1 << (end - shift)) - 1)
        t, p = (table >> np.uint64(shift)) & mask, (probes >> np.uint64(shift)) & mask
        at, ap = np.argsort(t, kind="stable"), np.argsort(p, kind="stable")
        values, first, n = np.unique(t[at], return_index=True, return_counts=True)
        low, high = np.searchsorted(p[ap], values), np.searchsorted(p[ap], values, side="right")
        for f, c, lo, hi in zip(first, n, low, high, strict=True):
            if c + hi - lo > 1:
                edges.append(_roots(*_reach(table[at[f : f + c]], probes[ap[lo:hi]], distance)))
    return _roots(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])) if edges else (table[:0], table[:0])


def _small_buckets(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in many small buckets at once: row j against row j + 1, j + 2, ... as long as the bucket lasts."""
    last = np.repeat(starts + sizes, sizes)
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)]) if len(starts) else np.zeros(0, dtype=np.int64)
    left, right, step = [], [], 1
    while len(at):
        live = at + step < last
        at, last = at[live], last[live]
        other = at + step
        hit = (np.bitwise_count(fp[at] ^ fp[other]) <= distance) & ~(probe[at] & probe[other])
        left.append(fp[at[hit]])
        right.append(fp[other[hit]])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def gather(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)
    del held
    release_memory()


def _linker(distance: int, small: int = 48):
    """For partitions sorted by bucket: star edges with the components of the links of all their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = 0

        def flush(rows) -> None:
            nonlocal edges, pending
            key, fp, probe = (np.concatenate(x) for x in zip(*rows, strict=True))
            starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
            sizes = np.diff(np.append(starts, len(key)))
            some = (sizes > 1) & (sizes <= small)
            edges.append(_small_buckets(key, fp, probe, starts[some], sizes[some], distance))
            for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
                f, p = fp[s : s + n], probe[s : s + n]
                edges.append(link_bucket(f[~p], f[p], distance))
            pending += sum(len(e[0]) for e in edges[-1 - int((sizes > small).sum()) :])
            if pending > 2_000_000:
                edges = [_roots(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))]
                pending = 0

        for batch in gather(batches):
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            probe = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cut = np.searchsorted(key, key[-1]) if len(key) else 0
            if cut:  # what came before the last bucket is complete
                flush([*held, (key[:cut], fp[:cut], probe[:cut])])
                held = []
            held.append((key[cut:], fp[cut:], probe[cut:]))
        if sum(len(x[0]) for x in held):
            flush(held)
        if edges:
            a, b = _roots(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _expander(segments: Segments, blocks: dict[int, int]):
    """Fingerprints to bucket entries; a bucket named in ``blocks`` is dealt in that many blocks, each with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gather(batches):
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 50_000):
                bucket, fp, probe = segments.entries(every[k : k + 50_000])
                bucket, pair = bucket.view(np.int64), np.zeros(len(fp), dtype=np.int64)
                if blocks:
                    hot = np.isin(bucket, np.fromiter(blocks, dtype=np.int64))
                    keep, more = ~hot, []
                    for i in np.nonzero(hot)[0]:
                        n = blocks[int(bucket[i])]
                        own = int(fp[i] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % n
                        more += [(i, min(own, o) * n + max(own, o) + 1) for o in range(n)]
                    rows, ids = np.array([m[0] for m in more], dtype=np.int64), np.array([m[1] for m in more], dtype=np.int64)
                    bucket, fp, probe, pair = (np.concatenate([x[keep], y]) for x, y in ((bucket, bucket[rows]), (fp, fp[rows]), (probe, probe[rows]), (pair, ids)))
                # buckets use the top bits for the segment only, so pairs of blocks fit between them and the value
                yield pa.RecordBatch.from_arrays([pa.array(bucket + (pair << 34)), pa.array(fp.view(np.int64)), pa.array(probe)], ["bucket", "fp", "probe"])

    return run


def near_links(fps: DataFrame, distance: int, parts: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what all pairs of distinct fingerprints (column ``fp``) within ``distance`` bits connect."""
    distinct = fps.select("fp").distinct()
    n = distinct.count()
    segments = Segments(distance, parts) if parts else Segments.for_count(distance, n)
    entries = distinct.mapInArrow(_expander(segments, {}), "bucket long, fp long, probe boolean")
    # At most (entries / BLOCK) buckets can be that large.
    hot = {r["bucket"]: -(-r["n"] // BLOCK) for r in entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).collect()} if n > BLOCK else {}
    if hot:
        entries = distinct.mapInArrow(_expander(segments, hot), "bucket long, fp long, probe boolean")
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_linker(distance), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 4, distance: int = 4, parts: int | None = None, tables: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``root`` and ``component_id`` (the smallest doc_id reachable over links) of every row.

    ``root`` tells a component from others, also where rows with equal doc_id stand in several or no row of it has one.

    Fingerprints link if they differ in at most ``distance`` bits; equal ones always link, so texts without
    words (fingerprint 0) do. With more ``tables``, two texts link if they do in any of that many independent fingerprints: a
    pair near the distance is found more surely, and no more unrelated pairs than so many times. Rows with a null doc_id get a
    component like others; it is null if no member has a doc_id. Equal rows give equal rows. An empty table gives an empty result.
    Only distinct fingerprints are compared, and within a bucket a forest stands for all pairs, so large groups of copies make no
    more edges than members.
    """
    table = materialize(simhash(docs, words, tables), "fingerprints")
    names = _names(tables)
    each = materialize(table.groupBy(*names).agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "distinct-fingerprints")
    met = each
    for c in names:
        roots = component_roots(near_links(each.select(F.col(c).alias("fp")), distance, parts), "a", "b").select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        met = met.join(roots, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    root = "root_fp"
    if tables > 1:  # what a further table joins, it joins in the first one's components
        met = materialize(met, "roots")
        joins = None
        for c in names[1:]:
            own = met.join(met.groupBy(f"root_{c}").agg(F.min(root).alias("b")), f"root_{c}").select(F.col(root).alias("a"), "b").where("a <> b").distinct()
            joins = own if joins is None else joins.unionAll(own)
        met = met.join(component_roots(joins, "a", "b").select(F.col("node").alias(root), "root"), root, "left").withColumn(root, F.coalesce("root", root))
    met = materialize(met, "rooted")
    lows = materialize(met.groupBy(root).agg(F.min("low").alias("component_id"), F.count("*").alias("many")), "lows")
    named = materialize(spread_join(met, lows, [root], "many").select(*names, F.col(root).alias("root"), "component_id", "copies"), "components")
    return spread_join(table, named, names, "copies").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that come first in their component: least doc_id, then least text digest.

    A null doc_id comes last. Of rows with equal doc_id and text one stays. Texts of rows that a sieve of what goes clears aren't shuffled.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("k"), F.min_by(F.lit(1), order).alias("one"))
    kept = materialize(first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")), "kept")
    gone = groups.join(kept, groups["doc_id"].eqNullSafe(kept["__id"]) & (groups["text_hash"] == kept["__hash"]), "left_anti")
    again = groups.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    names = gone.select("doc_id", "text_hash").unionAll(again).select(record_digest(F.col("doc_id"), F.col("text_hash")).alias("k"))
    keyed = docs.withColumn("__key", text_hash())
    met = key_sieve(names, "k")(record_digest(F.col("doc_id"), F.col("__key")))
    rows = keyed.where(met)
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__key"] == kept["__hash"]), "left_semi")
    if again.limit(1).count():  # such rows pass the sieve all
        rows = rows.dropDuplicates(["doc_id", "__key"])
    return keyed.where(~met).unionAll(rows).drop("__key")
