"""Vector best-fit packing of tokenised documents into sequences.

Every piece of length L needs the vector (L tokens, 1 document, L * L attention cost). Bins are chosen on a
histogram of lengths, at most ``capacity`` numbers whatever the corpus, so the plan is made once on the driver
and pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import materialize, slabs, small_batches
from orelode.llm.sharding import number_within
from orelode.llm.spans import per_text, span_digests, white

CAPACITY = 1024
END_ID = 2
#: Distinct words whose ids a Python worker remembers (about 60 bytes each).
WORD_CACHE = 300_000

_FAR_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_FAR_STARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: How the byte-level vocabulary parts a text before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _visible_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordTokenizer:
    """Token ids of whole texts, with each distinct word encoded once.

    A byte-level BPE with this pre-tokenizer never joins characters across a single space between two characters
    that are not white space, so a text's ids are those of its pieces " word" in a row. Words are told apart
    by 64-bit digests, and new ones are merged by the faster library over the same vocabulary, in which a
    token's id is its rank. Texts with other white space next to a space, or at an end, are encoded whole, and so are
    those that hold an added token's content, which the tokenizer turns into that token's id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values() if t.content]
        of = _visible_bytes()
        ranks = {bytes(of[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if i not in added}
        self.merges = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at, self.n, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    @staticmethod
    def plain(raws: Sequence[bytes]) -> np.ndarray:
        """Whether every space of a text stands between two characters that aren't white space (no text: False)."""
        buffer, starts = b"".join(raws), np.cumsum([0, *map(len, raws)])
        codes = np.frombuffer(buffer, dtype=np.uint8)
        space, blank = codes == 32, white(codes)
        bad = np.zeros(len(codes) + 1, dtype=bool)
        bad[:-2] = (space[:-1] & blank[1:]) | (blank[:-1] & space[1:])
        full = np.diff(starts) > 0
        good = full.copy()
        good[full] &= ~blank[starts[:-1][full]] & ~blank[starts[1:][full] - 1]
        good &= per_text(bad, starts) == 0  # a pair over a text's end makes a text that ends in white space bad, which it is
        if any(s in buffer for s in _FAR_STARTS):
            good &= [not _FAR_SPACE.search(r) for r in raws]
        return good

    def _learn(self, keys: np.ndarray, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        inner = codes[begins] == 32
        counts, places = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        flat, base = [self.ids], len(self.ids)
        if inner.any():  # one text; each piece begins with the only token in it that begins with a space
            n = (ends - begins)[inner]
            text = codes[np.arange(n.sum()) + np.repeat(begins[inner] - (np.cumsum(n) - n), n)].tobytes().decode()
            ids = np.array(self.merges.encode_ordinary(text), dtype=np.uint32)
            at = np.nonzero(self.opens[ids])[0]
            if len(at) != len(n):
                raise ValueError("this vocabulary doesn't keep a space at the start of a token")
            counts[inner], places[inner] = np.diff(np.append(at, len(ids))), at + base
            flat.append(ids)
            base += len(ids)
        for i in np.nonzero(~inner)[0]:
            ids = self.merges.encode_ordinary(codes[begins[i] : ends[i]].tobytes().decode())
            counts[i], places[i] = len(ids), base
            flat.append(np.array(ids, dtype=np.uint32))
            base += len(ids)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.n, self.ids = keys[order], np.concatenate([self.at, places])[order], np.concatenate([self.n, counts])[order], np.concatenate(flat)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry: the end)."""
        raws = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
        plain = self.plain(raws)
        for token in self.added:
            plain &= [token not in r for r in raws]
        sizes = np.zeros(len(raws), dtype=np.int64)
        chosen = [r for r, p in zip(raws, plain, strict=True) if p]
        flat, starts = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        if chosen:
            codes = np.frombuffer(b"".join(chosen), dtype=np.uint8)
            begin = np.cumsum([0, *map(len, chosen)])
            first = np.zeros(len(codes) + 1, dtype=bool)
            first[:-1] = codes == 32
            first[begin] = True
            cuts = np.nonzero(first)[0]
            b, e = cuts[:-1], cuts[1:]
            unique, index, inverse = np.unique(span_digests(codes, b, e), return_index=True, return_inverse=True)
            new = ~np.isin(unique, self.keys, assume_unique=True)
            if len(self.keys) + new.sum() > WORD_CACHE:
                self.clear()
                new[:] = True
            if new.any():
                self._learn(unique[new], codes, b[index[new]], e[index[new]])
            known = np.searchsorted(self.keys, unique)
            at, n = self.at[known][inverse], self.n[known][inverse]
            word_ends = np.cumsum(n)
            flat = self.ids[np.arange(word_ends[-1]) + np.repeat(at - (word_ends - n), n)]
            starts = np.append(0, word_ends)[np.searchsorted(b, begin)]
            sizes[plain] = np.diff(starts)
        if plain.all():
            return flat, starts
        others = {i: self.whole(raws[i].decode()) for i in np.nonzero(~plain)[0] if raws[i]}
        for i, ids in others.items():
            sizes[i] = len(ids)
        parts, k = [], 0
        for i, p in enumerate(plain):
            if p:
                parts.append(flat[starts[k] : starts[k + 1]])
                k += 1
            elif i in others:
                parts.append(others[i])
        return np.concatenate(parts) if parts else flat, np.concatenate([[0], np.cumsum(sizes)])


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int, end_id: int, emit: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        for part in slabs(frames, "text", 250_000):
            ids, starts = tokenizer.encode(part["text"].tolist())
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], emit: []}
            for k, doc_id in enumerate(part["doc_id"]):
                own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id))
                cut = len(own) % capacity if len(own) > capacity else len(own)
                edges = [0, *range(cut or capacity, len(own) + 1, capacity)]
                for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(j)
                    rows["start"].append(a)
                    rows["length"].append(b - a)
                    rows[emit].append(zlib.crc32(own[a:b].astype("<u4").tobytes()) if emit == "ids_crc32" else own[a:b].astype(np.int64))
            frame = pd.DataFrame(rows)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, emit: str = "ids") -> DataFrame:
    """Each document's ids, closed by ``end_id``, cut into pieces of at most ``capacity``: ``doc_id, piece, start, length`` and the ids.

    Only longer documents are cut; their first piece takes the remainder. ``emit`` is ``ids`` (array of long) or
    ``ids_crc32`` (the unsigned crc32 of the ids as little-endian 32-bit numbers). A null text is empty: one id.
    """
    if emit not in ("ids", "ids_crc32"):
        raise ValueError(emit)
    kind = "array<long>" if emit == "ids" else "long"
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_pieces(tokenizer, capacity, end_id, emit), f"doc_id long, piece int, start long, length long, {emit} {kind}")


@dataclass
class _Bins:
    """Some bins with the same content."""

    count: int
    left: tuple[int, int, int]
    content: tuple[tuple[int, int], ...]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> list[_Bins]:
    """Pack ``histogram`` (pieces of each length), longest first, each into the open bin that fits best.

    ``left`` of a bin is what remains of tokens, documents and attention cost, and no part may fall below zero.
    ``rule`` chooses among bins that can take a piece: ``norm`` the least weighted norm of what would remain,
    ``dot`` the greatest weighted product of the piece's needs and what remains, both as shares of the whole.
    Bins with equal content move together: a bin that takes a piece fits the next equal one best, until it is full.
    """
    whole = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], dtype=np.int64)
    weight = np.array(weights) / whole.astype(float) ** 2
    if any(L > capacity or L < 1 or L * L > whole[2] for L, n in histogram.items() if n):
        raise ValueError("a piece doesn't fit into an empty bin")
    bins: list[_Bins] = []
    for length in sorted(histogram, reverse=True):
        todo, need = histogram[length], np.array([length, 1, length * length], dtype=np.int64)
        while todo:
            left = np.array([b.left for b in bins], dtype=np.int64).reshape(-1, 3)
            fits = np.nonzero((left >= need).all(axis=1))[0]
            if len(fits):
                after = left[fits] - need
                score = -(left[fits] * need * weight).sum(axis=1) if rule == "dot" else (after.astype(float) ** 2 * weight).sum(axis=1)
                i = int(fits[np.argmin(score)])
                chosen = bins[i]
            else:
                i, chosen = -1, _Bins(todo, tuple(whole.tolist()), ())
            each = min(int(x) // int(n) for x, n in zip(chosen.left, need, strict=True))
            full = min(chosen.count, todo // each)
            rest = min(todo - full * each, each) if full < chosen.count else 0
            made = [_Bins(n, tuple(int(x) for x in np.array(chosen.left) - k * need), (*chosen.content, (length, k))) for n, k in ((full, each), (1, rest)) if n and k]
            if i >= 0:
                untouched = chosen.count - sum(b.count for b in made)
                bins[i : i + 1] = [_Bins(untouched, chosen.left, chosen.content)] if untouched else []
            bins += made
            todo -= full * each + rest
    return bins


def _runs(bins: list[_Bins]) -> pd.DataFrame:
    """Ranks of each length in runs: from rank ``first``, ``copies`` to a bin, over ``bins`` bins from ``base``."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for b in bins:
        offset = 0
        for length, copies in b.content:
            rows.append((length, ranks.get(length, 0), b.count, base, offset))
            ranks[length] = ranks.get(length, 0) + b.count * copies
            offset += length * copies
        base += b.count
    return pd.DataFrame(rows, columns=["length", "first", "bins", "base", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, **limits) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece (column ``length``); see :func:`plan_bins` for the limits.

    ``pieces`` is written once, so tokenising is not repeated. The only thing the driver gets is the count of
    each length. Pieces of equal length change places freely, hence hot lengths are numbered in blocks.
    """
    table = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = _runs(plan_bins(histogram, capacity, **limits)).sort_values(["length", "first"])
    step = max(histogram.values(), default=0) + 1
    key = runs["length"].to_numpy(dtype=np.int64) * step + runs["first"].to_numpy(dtype=np.int64)
    first, bins, base, offset = (runs[c].to_numpy(dtype=np.int64) for c in ("first", "bins", "base", "offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(dtype=np.int64), frame["_rank"].to_numpy(dtype=np.int64)
            at = np.searchsorted(key, length * step + rank, side="right") - 1
            k = rank - first[at]
            yield frame.drop(columns=["_rank", "_row"]).assign(sequence_id=base[at] + k % bins[at], offset=offset[at] + k // bins[at] * length)

    ranked = number_within(table, "length", "_rank", block_rows=1 << 20)
    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "_row", "_rank").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, emit: str = "ids", **limits) -> DataFrame:
    """Pieces of all documents with their sequence and place in it: :func:`token_pieces`, then :func:`pack`.

    Null and empty texts are one id long, equal rows are packed each, an empty table gives no pieces, other
    columns are dropped.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, emit), capacity, **limits)
