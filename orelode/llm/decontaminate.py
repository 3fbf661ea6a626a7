"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment within an edit budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import char_codes, slabs, small_batches, text_hash
from orelode.llm.spans import BASE, lower_table, mix, owner, word_character_table

Q = 8
#: Edits that a passage may differ by, as a share of its letters and numerals.
EDIT_SHARE = 0.1
#: Items with fewer letters and numerals are found only letter for letter and as whole words, those with under Q only as a whole text: they'd be met by chance.
LEAST_LETTERS = 40
#: Letters of items that are searched at once; more items are searched in blocks.
BLOCK_LETTERS = 4_000_000
FILTER_BITS = 22


def _letters(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters and numerals of all texts in a row, their places in the joined texts, and where each text's begin."""
    codes, starts = char_codes(texts)
    at = np.nonzero(word_character_table()[codes])[0]
    return lower_table()[codes[at]], at, np.searchsorted(at, starts)


def _grams(letters: np.ndarray) -> np.ndarray:
    """A digest of each run of Q = 8 letters."""
    value = letters.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        if len(value) <= step:
            return value[:0]
        value = value[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + value[step:]
    return mix(value)


def banded_edits(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """The least edits, and the end in ``region``, of ``item`` against any stretch of it, on diagonals ``low`` to ``high``.

    None if they are over ``most``. Row i of the band holds ends i + low ... i + high.
    """
    width = high - low + 1
    far = most + 1
    now = np.where((np.arange(width) + low >= 0) & (np.arange(width) + low <= len(region)), 0, far)
    steps = np.arange(width)
    for i in range(1, len(item) + 1):
        ends = steps + i + low
        valid = (ends >= 1) & (ends <= len(region))
        same = np.zeros(width, dtype=bool)
        same[valid] = region[ends[valid] - 1] == item[i - 1]
        nxt = np.minimum(now + ~same, np.append(now[1:], far) + 1)
        nxt = np.where((ends >= 0) & (ends <= len(region)), nxt, far)
        nxt = np.minimum.accumulate(nxt - steps) + steps
        now = np.where((ends >= 0) & (ends <= len(region)), nxt, far)
        if now.min() > most:
            return None
    k = int(np.argmin(now))
    return (int(now[k]), int(k + len(item) + low)) if now[k] <= most else None


@dataclass
class Benchmark:
    """The q-grams of a block of items, sorted by digest."""

    ids: list[int | None]
    letters: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray
    places: np.ndarray
    seen: np.ndarray
    #: The ids of items with under Q letters, by their letters.
    tiny: dict[bytes, list[int | None]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str], edit_share: float = EDIT_SHARE) -> Benchmark:
        letters, _, starts = _letters(texts)
        own = [letters[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        tiny: dict[bytes, list[int | None]] = {}
        for i, x in enumerate(own):
            if 0 < len(x) < Q:
                tiny.setdefault(x.tobytes(), []).append(ids[i])
        use = [i for i, x in enumerate(own) if len(x) >= Q]
        own = [own[i] for i in use]
        size = np.array([len(x) for x in own], dtype=np.int64)
        # An item of n letters shares at least n - Q + 1 - Q * edits q-grams with what has that many edits.
        budget = np.where(size < LEAST_LETTERS, 0, np.minimum((size * edit_share).astype(np.int64), (size - Q) // Q))
        grams = [_grams(x) for x in own]
        digest = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        items = np.repeat(np.arange(len(own)), [len(g) for g in grams])
        places = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, dtype=np.int64)]).astype(np.int64)
        order = np.argsort(digest, kind="stable")
        keys, first = np.unique(digest[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls([ids[i] for i in use], own, budget, size - Q + 1 - Q * budget, keys, np.append(first, len(digest)), items[order], places[order], seen, tiny)

    def matches(self, texts) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item_id, begin, end, edits) of each passage: offsets in the text, at most one of an item in a band."""
        letters, at, starts = _letters(texts)
        text_starts = np.concatenate([[0], np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts])])
        place = lambda t, start, end: (int(at[start] - text_starts[t]), int(at[end - 1] + 1 - text_starts[t]))
        short = np.nonzero((np.diff(starts) > 0) & (np.diff(starts) < Q))[0].tolist() if self.tiny else []
        whole = [(t, i, *place(t, starts[t], starts[t + 1]), 0) for t in short for i in self.tiny.get(letters[starts[t] : starts[t + 1]].tobytes(), [])]
        return whole + [(t, self.ids[i], *place(t, start, end), edits) for t, i, start, end, edits in self._passages(letters, at, starts)]

    def _passages(self, letters: np.ndarray, at: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits) of passages of items of Q letters or more, counted in ``letters``."""
        grams = _grams(letters)
        if not len(self.keys) or not len(grams):
            return []
        place = np.nonzero(self.seen[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
        key = np.searchsorted(self.keys, grams[place])
        hit = self.keys[np.minimum(key, len(self.keys) - 1)] == grams[place]
        place, key = place[hit], key[hit]
        text = owner(starts, place)
        whole = place + Q <= starts[text + 1]
        place, key, text = place[whole], key[whole], text[whole]
        n = self.first[key + 1] - self.first[key]
        row = np.repeat(np.arange(len(place)), n)
        post = self.first[key[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        item, gram = self.items[post], self.places[post]
        diagonal = place[row] - gram
        stride = 2 * self.budget[item] + 1
        # Each band is two strides wide and they overlap by one, so the diagonals of a match stand in one of them.
        band = np.concatenate([diagonal // stride, diagonal // stride - 1])
        group = np.stack([np.tile(text[row], 2), np.tile(item, 2), band], axis=1)
        grams2 = np.tile(gram, 2)
        order = np.lexsort((grams2, group[:, 2], group[:, 1], group[:, 0]))
        group, grams2, diagonals = group[order], grams2[order], np.tile(diagonal, 2)[order]
        if not len(group):
            return []
        new = np.append(True, (group[1:] != group[:-1]).any(axis=1))
        other = new | np.append(True, grams2[1:] != grams2[:-1])  # each q-gram of the item counts once in a band
        begin = np.nonzero(new)[0]
        count = np.add.reduceat(other.astype(np.int64), begin)
        ripe = count >= self.needed[group[begin, 1]]
        found: dict[tuple[int, int, int], tuple[int, int]] = {}
        ends = np.append(begin[1:], len(group))
        for (t, i, b), here in zip(group[begin[ripe]].tolist(), map(slice, begin[ripe], ends[ripe]), strict=True):
            budget, own = int(self.budget[i]), self.letters[i]
            step = 2 * budget + 1
            values, times = np.unique(diagonals[here], return_counts=True)
            exact = [d for d in values[times >= len(own) - Q + 1].tolist() if starts[t] <= d and d + len(own) <= starts[t + 1] and np.array_equal(letters[d : d + len(own)], own)]
            if len(own) < LEAST_LETTERS:
                border = lambda k, t=t: k in (starts[t], starts[t + 1]) or at[k] > at[k - 1] + 1
                exact = [d for d in exact if border(d) and border(d + len(own))]
            for d in exact:  # no need to align
                found[(t, i, (d + len(own)) // len(own))] = (0, d + len(own), d)
            if exact or len(own) < LEAST_LETTERS:
                continue
            low, high = b * step - budget, (b + 2) * step - 1 + budget
            region = letters[max(starts[t], low) : min(starts[t + 1], high + len(own))]
            base = max(starts[t], low)
            result = banded_edits(own, region, low - base, high - base, budget)
            if result is None:
                continue
            edits, end = result
            back = banded_edits(own[::-1], region[:end][::-1], -budget, budget, edits)
            start = end - (back[1] if back else len(own))
            key3 = (t, i, (base + end) // max(1, len(own)))
            near = next((k for k in (key3, (t, i, key3[2] - 1), (t, i, key3[2] + 1)) if k in found and abs(found[k][1] - base - end) <= step), None)
            if near is None or found[near][0] > edits:
                found.pop(near, None)
                found[key3] = (edits, int(base + end), int(base + start))
        return [(t, i, start, end, edits) for (t, i, _), (edits, end, start) in found.items()]


def benchmark_blocks(benchmark: DataFrame, edit_share: float = EDIT_SHARE, block_letters: int = BLOCK_LETTERS) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_letters`` letters, so what a task holds is bounded however many items there are."""
    rows = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_letters)
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Benchmark.of([r["item_id"] for r in own], [r["text"] for r in own], edit_share)


def find_passages(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``doc_id, text_hash, item_id, begin, end, edits``: where whole texts hold an item within its edit budget.

    Letters are compared without case; white space and punctuation don't count. The budget is ``edit_share`` of an item's letters and
    numerals; items with under ``LEAST_LETTERS`` of them have none and must stand as whole words, and those with under ``Q`` are found
    only where a text is nothing else. Null and empty texts and items hold nothing, equal rows give equal results, rows with a null doc_id
    and items with a null item_id keep it. An empty benchmark gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    schema = "doc_id long, text_hash long, item_id long, begin long, end long, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for own in benchmark_blocks(benchmark, edit_share, block_letters):

        def run(frames: Iterator[pd.DataFrame], own: Benchmark = own) -> Iterator[pd.DataFrame]:
            for part in slabs(frames, "text"):
                found = own.matches(part["text"].tolist())
                at = [m[0] for m in found]
                rest = pd.DataFrame([m[1:] for m in found], columns=["item_id", "begin", "end", "edits"]).astype({"item_id": "Int64"})
                yield pd.concat([part[["doc_id", "text_hash"]].iloc[at].reset_index(drop=True), rest], axis=1)

        out = out.unionAll(rows.mapInPandas(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no item, be its item_id null or not; see :func:`find_passages`. Null and empty texts stay."""
    small_batches(docs.sparkSession)
    for own in benchmark_blocks(benchmark, edit_share, block_letters):
        docs = docs.where(_holds_none(own)("text"))
    return docs


def _holds_none(own: Benchmark):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        good = np.ones(len(text), dtype=bool)
        for part in slabs(iter([pd.DataFrame({"text": text, "i": np.arange(len(text))})]), "text"):
            good[part["i"].to_numpy()[[m[0] for m in own.matches(part["text"].tolist())]]] = False
        return pd.Series(good)

    return clean
