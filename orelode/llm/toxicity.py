"""Toxicity: a factorization machine over hashed terms, so that pairs of terms weigh beyond their sum."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import bounded_sample, char_codes, release_memory, slabs, small_batches
from orelode.llm.spans import letter_table, lower_table, mix, owner, runs, span_digests

BUCKETS = 1 << 20
#: A word's terms are the word and its beginnings of so many letters, where it has more.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Labelled documents that training may take at most.
TRAIN_ROWS = 5000
#: A bucket is a term of the model if so many training documents have it. Terms aren't screened by label, so that two may matter only together.
LEAST_DOCS = 4
#: A term's weight in a text is the square of this and of how far its rates in both labels are apart (as logarithms).
LEAST_WEIGHT = 0.3
#: One training document of so many is set aside to place the score.
CALIBRATE_ONE_OF = 5
#: With fewer of them of either label the score stays where training puts it.
LEAST_CALIBRATION = 5
THRESHOLD = 0.7


def term_buckets(texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the terms of every text: words (runs of letters, lower-cased) and their beginnings, hashed.

    ``wanted`` flags the buckets to be returned (None: all).
    """
    codes, starts = char_codes(texts)
    b, e = runs(letter_table()[codes], starts)
    lower, of = lower_table()[codes], owner(starts, b)
    digests, first, inverse = np.unique(span_digests(lower, b, e), return_index=True, return_inverse=True)
    b, e = b[first], e[first]
    # Each distinct word of a text once, with its count; then the terms of each.
    pair, times = np.unique(of * max(1, len(b)) + inverse, return_counts=True)
    row, word = pair // max(1, len(b)), pair % max(1, len(b))
    rows, values, counts = [row], [digests[word]], [times]
    for k in BEGINNINGS:
        longer = e - b > k
        own = np.zeros(len(b), dtype=np.uint64)
        own[longer] = mix(span_digests(lower, b[longer], b[longer] + k) + np.uint64(k))
        some = longer[word]
        rows.append(row[some])
        values.append(own[word[some]])
        counts.append(times[some])
    bucket = (np.concatenate(values) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)
    row, count = np.concatenate(rows), np.concatenate(counts)
    if wanted is not None:
        some = wanted[bucket]
        row, bucket, count = row[some], bucket[some], count[some]
    key, inverse = np.unique(row * BUCKETS + bucket, return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(inverse, weights=count, minlength=len(key)).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _row_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[begin:end]``; empty ranges give 0."""
    out = np.zeros((len(begin), *values.shape[1:]))
    some = end > begin
    if some.any():
        out[some] = np.add.reduceat(values, begin[some], axis=0)
    return out


@dataclass
class FactorizationMachine:
    """``base + w.x + sum over pairs of <v_i, v_j> x_i x_j`` over the weights x of the terms of a text, plus ``shift``.

    x is the logarithm of a term's count plus one, times the term's weight, and each text's x has length 1.
    """

    terms: np.ndarray
    weight: np.ndarray
    base: float
    linear: np.ndarray
    factors: np.ndarray
    shift: float = 0.0

    def margin(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """For triples sorted by row, each term of a row once. The sum over pairs is half of what the square of the sum has over the sum of squares."""
        begin = np.searchsorted(row, np.arange(n + 1))
        own = self.factors[term] * x[:, None]
        sums = _row_sums(own, begin[:-1], begin[1:])
        squares = _row_sums((own**2).sum(axis=1), begin[:-1], begin[1:])
        return self.base + np.bincount(row, weights=self.linear[term] * x, minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares)

    def inputs(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, x) of the buckets that are terms."""
        at = np.full(BUCKETS, -1, dtype=np.int32)
        at[self.terms] = np.arange(len(self.terms))
        term = at[bucket]
        row, term, count = row[term >= 0], term[term >= 0], count[term >= 0]
        x = np.log1p(count) * self.weight[term]
        length = np.sqrt(np.bincount(row, weights=x**2)) if len(row) else np.zeros(0)
        return row, term, x / np.maximum(length[row], 1e-12)

    def score(self, texts) -> np.ndarray:
        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[self.terms] = True
        row, term, x = self.inputs(*term_buckets(texts, wanted))
        return _sigmoid(self.margin(row, term, x, len(texts)) + self.shift)


def best_cut(margin: np.ndarray, y: np.ndarray) -> float | None:
    """The margin that parts the labels with the best F1, in the middle between two rows (of equals the lowest); None if a label is too rare."""
    if min(y.sum(), len(y) - y.sum()) < LEAST_CALIBRATION:
        return None
    order = np.argsort(-margin, kind="stable")
    z = margin[order]
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = 0  # no cut between equals
    last = int(np.nonzero(f1 >= f1.max() - 1e-12)[0][-1])
    return float((z[last] + z[min(last + 1, len(z) - 1)]) / 2)


def fit_machine(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, y: np.ndarray, calibrate: np.ndarray | None = None, width: int = 4, epochs: int = 10, least_steps: int = 200, rate: float = 0.1, ridge: float = 1e-4, batch: int = 128, seed: int = 0) -> FactorizationMachine:
    """Descend the logistic loss in small batches with steps scaled by past gradients; ``ridge`` holds weights and factors alike.

    Triples are sorted by row. Rows flagged in ``calibrate`` aren't learned from: the score is moved so that THRESHOLD falls on the margin
    that parts their labels best.
    """
    rng, n = np.random.default_rng(seed), len(y)
    held = np.zeros(n, dtype=bool) if calibrate is None else calibrate
    learn = np.nonzero(~held)[0]
    ones = float(y[learn].sum())
    part = float(np.clip(ones / len(learn) if len(learn) else 0.1, 1e-3, 1 - 1e-3))
    own = ~held[row]
    seen, hits = np.bincount(bucket[own], minlength=BUCKETS), np.bincount(bucket[own], weights=y[row[own]], minlength=BUCKETS)
    terms = np.nonzero(seen >= LEAST_DOCS)[0]
    apart = np.abs(np.log((hits[terms] + 1) / (ones + 2)) - np.log((seen[terms] - hits[terms] + 1) / (len(learn) - ones + 2)))
    model = FactorizationMachine(terms, (apart + LEAST_WEIGHT) ** 2, float(np.log(part / (1 - part))), np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), width)))
    row, term, x = model.inputs(row, bucket, count)
    begin = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
    past = [1e-6, np.full(len(terms), 1e-6), np.full((len(terms), width), 1e-6)]
    batches = max(1, len(learn) // batch)
    for _ in range(max(epochs, -(-least_steps // batches)) if len(terms) else 0):
        for rows in np.array_split(rng.permutation(learn), batches):
            size = begin[rows + 1] - begin[rows]
            ends = np.cumsum(size)
            r = np.repeat(np.arange(len(rows)), size)
            at = np.arange(len(r)) + np.repeat(begin[rows] - (ends - size), size)
            t, v = np.unique(term[at], return_inverse=True)
            each = model.factors[t][v] * x[at][:, None]
            sums = _row_sums(each, ends - size, ends)
            z = model.base + np.bincount(r, weights=model.linear[t][v] * x[at], minlength=len(rows)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(r, weights=(each**2).sum(axis=1), minlength=len(rows)))
            error = (_sigmoid(z) - y[rows]) / len(rows)
            back = error[r] * x[at]
            g0, g1 = error.sum(), np.bincount(v, weights=back, minlength=len(t)) + ridge * model.linear[t]
            g2 = np.stack([np.bincount(v, weights=back * (sums[r, k] - each[:, k]), minlength=len(t)) for k in range(width)], axis=1) + ridge * model.factors[t]
            past[0] += g0**2
            past[1][t] += g1**2
            past[2][t] += g2**2
            model.base -= float(rate * g0 / np.sqrt(past[0]))
            model.linear[t] -= rate * g1 / np.sqrt(past[1][t])
            model.factors[t] -= rate * g2 / np.sqrt(past[2][t])
    cut = best_cut(model.margin(row, term, x, n)[held], y[held])
    if cut is not None:
        model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on at most ``most_rows`` rows of ``labels (doc_id, toxic)``, the first by a hash of doc_id; nulls are left out.

    Executors hash whole texts; the driver gets each document's distinct buckets and their counts, at most ``BUCKETS``. Without any labelled
    row every text scores alike.
    """
    small_batches(docs.sparkSession)
    chosen = bounded_sample(labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic"), "doc_id", most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            row, bucket, count = term_buckets(part["text"])
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            lists = lambda v: [v[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "toxic": part["toxic"].to_numpy(), "buckets": lists(bucket), "counts": lists(count)})

    found = rows.select("doc_id", "text", "toxic").mapInPandas(run, "doc_id long, toxic int, buckets binary, counts binary").toPandas().sort_values(["doc_id", "toxic", "buckets", "counts"])
    row = np.repeat(np.arange(len(found), dtype=np.int32), found["buckets"].str.len() // 4)
    bucket, count = (np.frombuffer(b"".join(found[c]), dtype="<i4") for c in ("buckets", "counts"))
    y = found["toxic"].to_numpy(dtype=float)
    aside = np.array([zlib.crc32(b"%d" % k) % CALIBRATE_ONE_OF == 0 for k in found["doc_id"]], dtype=bool)
    del found
    release_memory()
    model = fit_machine(row, bucket, count, y, aside)
    del row, bucket, count
    release_memory()
    return model


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for every row, from the whole text alone.

    A null or empty text, or one without a term of the model, gets the score of no terms at all. Equal rows score alike; texts of equal score
    keep it, as no order is made.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            score = model.score(part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": score, "predicted": (score >= threshold).astype("int32")})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int")
