"""Quality rules: document statistics and gradient-boosted trees over them, scored as flat numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import bounded_sample, char_codes, slabs, small_batches, text_hash
from orelode.llm.spans import letter_table, lower_table, mix, owner, per_text, runs, span_digests, window_digests, word_spans

#: Labelled documents that training may take at most.
TRAIN_ROWS = 8000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and how quality may move with each: -1 never up, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_char": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1,
    "stops_per_word": 0, "exclamations_per_word": -1, "digits_per_char": 0, "distinct_words": 0, "words_per_line": 0, "short_words": 0,
}


def _member(codes: np.ndarray, characters: str) -> np.ndarray:
    table = np.zeros(128, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return (codes < 128) & table[np.minimum(codes, 127)]


def document_statistics(texts) -> tuple[np.ndarray, np.ndarray]:
    """The counts of ``COUNTS`` (one row a text) and the features of ``FEATURES``.

    Words stand between ASCII white space; lines are parted at ``\\\\n``. Equality of lines, words and windows is that
    of 64-bit digests. A null text has no words.
    """
    codes, starts = char_codes(texts)
    n = len(starts) - 1
    b, e = word_spans(codes, starts)
    of = owner(starts, b)
    words = np.bincount(of, minlength=n)
    chars = np.bincount(of, weights=e - b, minlength=n).astype(np.int64)
    symbols = per_text(_member(codes, SYMBOLS), starts)
    # Lines that hold a word: from one break to the next, within a text.
    lb, le = runs(codes != 10, starts)
    word_before = np.zeros(len(codes) + 1, dtype=np.int64)
    word_before[1:][b] = 1
    word_before = np.cumsum(word_before)
    full = word_before[le] > word_before[lb] if len(lb) else np.zeros(0, dtype=bool)
    # A line may begin within the text at a place where no word begins, so count words that overlap it by their begins.
    lb, le = lb[full], le[full]
    lof = owner(starts, lb)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    lines = np.bincount(lof, minlength=n)
    distinct = np.unique(span_digests(codes, lb, le) + salt[lof], return_index=True)[1]
    dup = lines - np.bincount(lof[distinct], minlength=n)
    digests = span_digests(codes, b, e)
    windows = window_digests(digests, WINDOW)
    whole = of[WINDOW - 1 :] == of[: len(windows)] if len(windows) else np.zeros(0, dtype=bool)
    at = np.nonzero(whole)[0]
    _, inverse, seen = np.unique(windows[at] + salt[of[at]], return_inverse=True, return_counts=True)
    again = at[seen[inverse] > 1]
    cover = np.zeros(len(b) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeated = np.bincount(of, weights=np.cumsum(cover[:-1]) > 0, minlength=n).astype(np.int64)
    counts = np.stack([words, chars, symbols, dup, repeated], axis=1).astype(np.int64)
    letters = letter_table()[codes]
    different = np.bincount(of[np.unique(digests + salt[of], return_index=True)[1]], minlength=n)
    w, size = np.maximum(words, 1), np.maximum(np.diff(starts), 1)
    features = np.stack(
        [
            np.log1p(words),
            chars / w,
            symbols / size,
            dup / np.maximum(lines, 1),
            repeated / w,
            per_text(letters & (lower_table()[codes] != codes), starts) / np.maximum(per_text(letters, starts), 1),
            per_text(_member(codes, ".,;:?"), starts) / w,
            per_text(_member(codes, "!"), starts) / w,
            per_text(_member(codes, "0123456789"), starts) / size,
            different / w,
            words / np.maximum(lines, 1),
            np.bincount(of, weights=(e - b) <= 3, minlength=n) / w,
        ],
        axis=1,
    )
    return counts, features


@dataclass
class Trees:
    """Trees as arrays over all nodes; a leaf has feature -1. ``roots`` are the trees' first nodes."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(features), self.base)
        rows = np.arange(len(features))
        for root in self.roots:
            node = np.full(len(features), root)
            while True:
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                low = features[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 2.0, least: int = 8, bins: int = 64) -> Trees:
    """Boost depth-limited regression trees on the logistic loss.

    ``monotone`` is -1, 0 or 1 for each feature: a split that would order its sides the wrong way isn't taken, and both
    sides keep to their middle from then on, so the score is monotone in that feature.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    rate_of_ones = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin = np.full(len(x), base)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows], hess[rows]
        leaf = float(np.clip(g.sum() / (h.sum() + ridge), low, high))
        nodes.append([-1, 0.0, -1, -1, leaf * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + ridge)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = binned[f][rows]
                gl, hl, nl = (np.cumsum(np.bincount(k, weights=v, minlength=len(c) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
                gr, hr = g.sum() - gl, h.sum() - hl
                vl, vr = gl / (hl + ridge), gr / (hr + ridge)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
                ok = (nl >= least) & (len(rows) - nl >= least) & ((monotone[f] == 0) | (monotone[f] * (vr - vl) >= 0))
                if ok.any() and gain[i := int(np.argmax(np.where(ok, gain, -np.inf)))] > best[0]:
                    best = (float(gain[i]), f, i, float(vl[i]), float(vr[i]))
        if best[1] >= 0:
            _, f, i, vl, vr = best
            go = binned[f][rows] <= i
            middle = float(np.clip((np.clip(vl, low, high) + np.clip(vr, low, high)) / 2, low, high))
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[f])]
            a = grow(rows[go], level + 1, *bounds[0])
            b = grow(rows[~go], level + 1, *bounds[1])
            nodes[me] = [f, float(cuts[f][i]), a, b, 0.0]
        else:
            margin[rows] += leaf * rate
        return me

    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
    table = np.array(nodes or [[-1, 0, -1, -1, 0]], dtype=float)
    return Trees(base, np.array(roots, dtype=int), *(table[:, i].astype(int if i in (0, 2, 3) else float) for i in range(5)))


def statistics_frame(docs: DataFrame, features: bool = False) -> DataFrame:
    """``doc_id`` and the counts of every row; ``features`` adds an array of the model's features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            counts, values = document_statistics(part["text"])
            out = pd.DataFrame(counts, columns=COUNTS).assign(doc_id=part["doc_id"].to_numpy())
            yield out.assign(features=list(values)) if features else out

    small_batches(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", doc_id long" + ", features array<double>" * features
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``most_rows`` rows of ``labels (doc_id, quality)``, the first by a hash of doc_id; nulls are left out."""
    chosen = bounded_sample(labels.where("quality is not null and doc_id is not null").select("doc_id", "quality"), "doc_id", most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    found = statistics_frame(rows, features=True).select("doc_id", "features").toPandas()
    table = found.merge(chosen.toPandas(), on="doc_id")
    x = np.array(table["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_trees(x, table["quality"].to_numpy(dtype=float), np.array([*FEATURES.values()]))


def judge_quality(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """Every row's ``doc_id``, counts, ``base_failed``, ``quality`` (the model's probability) and ``kept``.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MOST_REPEATED`` of 100 words in repeated windows. Such rows
    aren't kept; of the others those are whose probability reaches ``threshold``. Null and empty texts have no
    words, so they fail. Equal rows are judged alike; other columns don't matter and are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            counts, values = document_statistics(part["text"])
            out = pd.DataFrame(counts, columns=COUNTS)
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
            score = model.score(values)
            yield out.assign(doc_id=part["doc_id"].to_numpy(), base_failed=failed, quality=score, kept=~failed & (score >= threshold), text_hash=part["text_hash"].to_numpy())

    small_batches(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", doc_id long, base_failed boolean, quality double, kept boolean, text_hash long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return rows.mapInPandas(run, schema).select("doc_id", *COUNTS, "base_failed", "quality", "kept", "text_hash")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`judge_quality` keeps, decided where they stand: nothing is shuffled."""

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), dtype=bool)
        for part in slabs(iter([pd.DataFrame({"text": text, "i": np.arange(len(text))})]), "text"):
            counts, values = document_statistics(part["text"])
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            out[part["i"]] = ~failed & (model.score(values) >= threshold)
        return pd.Series(out)

    small_batches(docs.sparkSession)
    return docs.where(good("text"))
