"""Boosted regression trees from histograms: all rows stay with the executors, only sums by bin go to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.checkpoint import discard, materialize

BITS = 5
#: Bins of a feature.
BINS = 1 << BITS
#: Features whose bins share a word of a row, and such words.
GROUP, WORD = 3, 1 << 3 * BITS
#: Rows in one packed record.
PACK = 1 << 18
#: Rows that a pass handles at a time.
SLICE = 1 << 15
#: Trees that are applied anew in each pass before the residuals are written again.
REPLAY = 6


@dataclass
class Tree:
    """A whole binary tree in heap order: a row goes left if its bin is at most ``cut`` (an unsplit node's is the last bin)."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def reach(self, words: int, depth: int) -> list[np.ndarray]:
        """For each word and each of its values the nodes of level ``depth`` (as bits) that a row with that value may be in."""
        kind = np.uint32 if depth <= 5 else np.uint64
        every = (1 << (1 << depth)) - 1
        own = [np.full(WORD, every, dtype=kind) for _ in range(words)]
        values = np.arange(WORD)
        for node in range((1 << depth) - 1):
            level = (node + 1).bit_length() - 1
            half = 1 << (depth - level - 1)
            left = ((1 << half) - 1) << (node + 1 - (1 << level)) * 2 * half
            word, slot = divmod(int(self.feature[node]), GROUP)
            goes = ((values >> BITS * slot) & (BINS - 1)) <= self.cut[node]
            own[word] &= np.where(goes, kind(every & ~(left << half)), kind(every & ~left))
        return own


class Places:
    """Finds the nodes of a level of a tree: each row's is a code, and ``table`` gives by code what is known by node."""

    def __init__(self, tree: Tree, words: int, depth: int):
        self.masks, self.depth = tree.reach(words, depth), depth
        self.prime = 37 if depth <= 5 else 67  # powers of two up to 2^31, or 2^63, have different remainders

    def codes(self, words: list[np.ndarray]) -> np.ndarray:
        one = self.masks[0][words[0]]
        for mask, word in zip(self.masks[1:], words[1:], strict=True):
            one &= mask[word]
        return (one % one.dtype.type(self.prime)).astype(np.intp)

    def table(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.prime, dtype=values.dtype)
        out[[pow(2, k, self.prime) for k in range(1 << self.depth)]] = values
        return out


@dataclass
class BoostedTrees:
    """Bounds of the bins of each feature, trees, and labels as multiples of ``1 / scale``, so that sums are exact in any order."""

    features: list[str]
    bounds: list[np.ndarray]
    scale: float
    start: int
    trees: list[Tree] = field(default_factory=list)

    def words(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """The bins of three features at a time in one number."""
        out = []
        for k in range(0, len(columns), GROUP):
            word = np.zeros(len(columns[0]), dtype=np.uint16)
            for slot, (x, bound) in enumerate(zip(columns[k : k + GROUP], self.bounds[k : k + GROUP], strict=True)):
                word |= np.searchsorted(bound, x, side="left").astype(np.uint16) << np.uint16(BITS * slot)
            out.append(word)
        return out

    def scores(self, words: list[np.ndarray]) -> np.ndarray:
        return (self.start - _replayed(words, np.zeros(len(words[0]), dtype=np.int64), _steps(self.trees, len(words)))) / self.scale


def _steps(trees: list[Tree], words: int) -> list[tuple[Places, np.ndarray]]:
    found = [(tree, Places(tree, words, tree.depth)) for tree in trees]
    return [(places, places.table(tree.leaf)) for tree, places in found]


def _replayed(words: list[np.ndarray], rest: np.ndarray, steps: list[tuple[Places, np.ndarray]]) -> np.ndarray:
    """What ``steps`` leave of the residuals."""
    for places, leaf in steps:
        rest = rest - leaf[places.codes(words)]
    return rest


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers (uint64) in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _top(key: int, bits: int) -> float:
    """The largest double whose number starts with the ``bits`` bits of ``key``."""
    whole = np.uint64((key + 1 << 64 - bits) - 1)
    number = whole ^ np.uint64(1 << 63) if whole >> np.uint64(63) else ~whole
    return float(np.array([number], dtype=np.uint64).view(np.float64)[0])


def _counted(rows: DataFrame, features: list[str], of: Callable[[int, np.ndarray], np.ndarray], size: int) -> list[dict[int, int]]:
    """For each feature how often each number under ``size`` occurs that ``of`` (feature, ordered numbers) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(features), size), dtype=np.int64)
        for batch in batches:
            for f, x in enumerate(_columns(batch, features)):
                np.add.at(sums[f], of(f, _ordered(x)), 1)
        f, key = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(key), pa.array(sums[f, key])], ["f", "key", "n"])

    found: list[dict[int, int]] = [{} for _ in features]
    for r in rows.select(*features).mapInArrow(run, "f int, key long, n long").groupBy("f", "key").agg(F.sum("n").alias("n")).collect():
        found[r["f"]][r["key"]] = r["n"]
    return found


def _quantile_keys(counts: dict[int, int]) -> list[int]:
    """The keys in which the 1/32, 2/32 ... quantiles lie; all keys if they are 32 at most."""
    keys = sorted(counts)
    ends = np.cumsum([counts[k] for k in keys])
    at = range(len(keys)) if len(keys) <= BINS else np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, BINS) / BINS))
    return [keys[i] for i in at]


def bin_bounds(rows: DataFrame, features: list[str], more: int = 10) -> list[np.ndarray]:
    """Up to 31 bounds of each feature that part all rows evenly: quantiles of the doubles' first 16 and ``more`` bits, counted in two passes.

    A feature with up to 32 values (to so many bits) has each in a bin of its own.
    """
    coarse = _counted(rows, features, lambda f, x: (x >> np.uint64(48)).astype(np.int64), 1 << 16)
    chosen = [_quantile_keys(own) for own in coarse]
    slots = np.full((len(features), 1 << 16), BINS)  # the last slot takes what no quantile lies in
    for f, keys in enumerate(chosen):
        slots[f, keys] = range(len(keys))

    def refined(f: int, x: np.ndarray) -> np.ndarray:
        return slots[f, (x >> np.uint64(48)).astype(np.int64)] << more | ((x >> np.uint64(48 - more)) & np.uint64((1 << more) - 1)).astype(np.int64)

    bounds = []
    for own, keys, parts in zip(coarse, chosen, _counted(rows, features, refined, BINS + 1 << more), strict=True):
        counts = {k << more: n for k, n in own.items() if k not in keys}
        counts |= {keys[k >> more] << more | k & (1 << more) - 1: n for k, n in parts.items() if k >> more < BINS}
        bounds.append(np.array([_top(k, 16 + more) for k in _quantile_keys(counts)])[: BINS - 1])
    return bounds


def _packer(model: BoostedTrees, label: str):
    """Rows to records: the words of up to ``PACK`` rows and what their labels differ from the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def record() -> pa.RecordBatch:
            words = [np.concatenate(w).tobytes() for w in zip(*(h[0] for h in held), strict=True)]
            rest = np.concatenate([h[1] for h in held]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.binary())), pa.array([rest], pa.binary())], ["words", "rest"])

        for batch in batches:
            y = np.rint(_columns(batch, [label])[0] * model.scale).astype(np.int32) - np.int32(model.start)
            held.append((model.words(_columns(batch, model.features)), y))
            n += len(y)
            if n >= PACK:
                yield record()
                held, n = [], 0
        if n:
            yield record()

    return run


def _records(batches: Iterator[pa.RecordBatch], replay: list[Tree], n_words: int, rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Words and residuals after ``replay``, up to ``rows`` at a time, as they stay in the processor's cache then."""
    steps = [(places, leaf.astype(np.int32)) for places, leaf in _steps(replay, n_words)]
    for batch in batches:
        for stored, left in zip(batch.column(0), batch.column(1), strict=True):
            words = [np.frombuffer(w.as_buffer(), dtype=np.uint16) for w in stored.values]
            rest = np.frombuffer(left.as_buffer(), dtype=np.int32)
            for k in range(0, len(rest), rows):
                part = [w[k : k + rows] for w in words]
                yield part, _replayed(part, rest[k : k + rows], steps)


def _rewriter(replay: list[Tree], n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, rest in _records(batches, replay, n_words, PACK):
            yield pa.RecordBatch.from_arrays([pa.array([[w.tobytes() for w in words]], pa.list_(pa.binary())), pa.array([rest.tobytes()], pa.binary())], ["words", "rest"])

    return run


def _summer(replay: list[Tree], tree: Tree, level: int, cubes: np.ndarray, n_words: int):
    """Counts and sums of residuals in the bins of ``cubes`` (node of the level, cube, feature along each axis), as one record of a task."""
    nodes, many, axes = cubes.shape
    size = BINS**axes
    kind = np.uint32 if n_words <= 2 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, many, nodes * size))
        places = Places(tree, n_words, level)
        bases = places.table(np.arange(nodes) * size)
        shifts = [[places.table((cubes[:, c, axis] * BITS).astype(kind)) for axis in range(axes)] for c in range(many)]
        for words, rest in _records(batches, replay, n_words, SLICE):
            whole = words[0].astype(kind)
            for k, word in enumerate(words[1:], 1):
                whole |= word.astype(kind) << kind(3 * BITS * k)
            weights, node = rest.astype(np.float64), places.codes(words) if level else None
            for c in range(many):
                key = bases[node] if level else np.zeros(len(rest), dtype=np.int64)
                for axis, shift in enumerate(shifts[c]):
                    bins = (whole >> (shift[node] if level else kind(cubes[0, c, axis] * BITS))) & kind(BINS - 1)
                    key += bins.astype(np.int64) << BITS * (axes - 1 - axis)
                total[0, c] += np.bincount(key, minlength=nodes * size)
                total[1, c] += np.bincount(key, weights=weights, minlength=nodes * size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _best_cut(sums: np.ndarray) -> tuple[int, float]:
    """The last bin to the left, and the gain, of the best cut of one feature's histogram (counts, sums); the first of equal ones."""
    n, s = np.cumsum(sums, axis=1)
    left, right = n[:-1], n[-1] - n[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left > 0) & (right > 0), s[:-1] ** 2 / left + (s[-1] - s[:-1]) ** 2 / right - s[-1] ** 2 / max(n[-1], 1), 0.0)
    at = int(np.argmax(gain))
    return (at, float(gain[at])) if gain[at] > 1e-9 * max(1.0, s[-1] ** 2 / max(n[-1], 1)) else (BINS - 1, 0.0)


def _grow(table: DataFrame, replay: list[Tree], n_words: int, depth: int, rate: float, drawn: np.ndarray) -> Tree:
    """The next tree; ``drawn`` holds the features of each node. If that is one, two levels are summed in one pass."""
    tree = Tree(depth, np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, BINS - 1), np.zeros(1 << depth, dtype=np.int64))
    ahead, level = 2 if drawn.shape[1] == 1 else 1, 0
    while level < depth:
        axes = min(ahead, depth - level)
        first, many = (1 << level) - 1, 1 << level
        if axes == 2:
            cubes = np.array([[[drawn[v, 0], drawn[2 * v + 1, 0]], [drawn[v, 0], drawn[2 * v + 2, 0]]] for v in range(first, first + many)])
        else:
            cubes = drawn[first : first + many, :, None]
        parts = table.mapInArrow(_summer(replay, tree, level, cubes, n_words), "sums binary").collect()
        total = np.zeros((2, cubes.shape[1], many) + (BINS,) * axes)
        for r in parts:
            total += np.frombuffer(r["sums"], dtype=np.float64).reshape(total.shape)
        for k in range(many):
            own, v = total[:, :, k], first + k
            if axes == 2:
                tree.feature[v], tree.cut[v] = drawn[v, 0], _best_cut(own[:, 0].sum(axis=2))[0]
                for side, child in ((own[:, 0, : tree.cut[v] + 1], 2 * v + 1), (own[:, 1, tree.cut[v] + 1 :], 2 * v + 2)):
                    below = side.sum(axis=1)
                    tree.feature[child], tree.cut[child] = drawn[child, 0], _best_cut(below)[0]
                    _fill(tree, child, below, rate)
            else:
                cuts = [_best_cut(own[:, c]) for c in range(own.shape[1])]
                c = max(range(len(cuts)), key=lambda i: cuts[i][1])
                tree.feature[v], tree.cut[v] = drawn[v, c], cuts[c][0]
                _fill(tree, v, own[:, c], rate)
        level += axes
    return tree


def _fill(tree: Tree, node: int, sums: np.ndarray, rate: float) -> None:
    """The leaves below a node of the last level: the step towards the mean of the residuals."""
    at = 2 * node + 1 - len(tree.feature)
    if at >= 0:
        for k, (n, s) in enumerate((sums[:, : tree.cut[node] + 1].sum(axis=1), sums[:, tree.cut[node] + 1 :].sum(axis=1))):
            tree.leaf[at + k] = round(rate * s / n) if n else 0


def fit(rows: DataFrame, features: list[str], label: str, trees: int, depth: int, rate: float, share: str, seed: int) -> BoostedTrees:
    """Trees on the squared error of all ``rows``, each from the residuals of those before; the start is the mean label.

    ``share`` of the features (``all`` or a fraction, one at least) is drawn at each node, cuts lie between up to 32 bins (:func:`bin_bounds`), a node
    without a gain stays whole. Null labels and features are not allowed; no rows give 0. Of equal cuts the first one counts. Rows are
    packed to 2 bytes for three features and 4 for the residual; labels are rounded to 24 bits of the largest, so sums don't depend on the order.
    A pass reads all rows and gives sums by node and bin. ``rows`` is read four times and should be a written table.
    """
    if not 1 <= depth <= 6 or len(features) > 4 * GROUP:
        raise ValueError("depth has to be 1 to 6, features at most 12")
    n, mean, most = rows.agg(F.count("*"), F.avg(label), F.max(F.abs(label))).first()
    if not n:
        return BoostedTrees(features, [np.zeros(0) for _ in features], 1.0, 0)
    scale = 2.0 ** (24 - math.ceil(math.log2(most))) if most else 1.0
    model = BoostedTrees(features, bin_bounds(rows, features), scale, 0)
    model.start = round(round(mean, 6) * scale)
    table = materialize(rows.select(*features, label).mapInArrow(_packer(model, label), "words array<binary>, rest binary"), "packed")
    n_words = -(-len(features) // GROUP)
    count = len(features) if share == "all" else max(1, math.ceil(float(share) * len(features)))
    draw, replay = np.random.default_rng(seed), []
    for _ in range(trees):
        drawn = np.array([np.sort(draw.permutation(len(features))[:count]) for _ in range((1 << depth) - 1)])
        tree = _grow(table, replay, n_words, depth, rate, drawn)
        model.trees.append(tree)
        replay = [*replay, tree]
        if len(replay) == REPLAY:
            before, table = table, materialize(table.mapInArrow(_rewriter(replay, n_words), "words array<binary>, rest binary"), "packed")
            discard(before)
            replay = []
    discard(table)
    return model


def predict(model: BoostedTrees, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and the score of each row."""
    schema = rows.select(*keys).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(model.words(_columns(batch, model.features)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(scores)], [*keys, name])

    return rows.select(*keys, *model.features).mapInArrow(run, schema)
