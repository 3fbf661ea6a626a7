"""Language identification: averaged hashed subword embeddings, a linear softmax, temperature and rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import char_codes, slabs, small_batches
from orelode.llm.spans import BASE, letter_table, lower_table, mix, per_text

BUCKETS = 1 << 15
#: Subwords are runs of so many characters of a word between its borders.
SIZES = (2, 3, 4)
#: Labelled documents of each language that training takes, about (rows are drawn by a hash).
TRAIN_PER_LANGUAGE = 600
BORDER = 1
UNKNOWN = "und"


def subwords(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: where subwords begin and their buckets. Characters are lower-cased; what isn't a letter is a border.

    A subword may begin or end with a border, but has none inside, and never reaches over a text's end.
    """
    letter = letter_table()[codes]
    lower = np.where(letter, lower_table()[codes], BORDER).astype(np.uint64) + np.uint64(1)
    gap = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(~letter, out=gap[1:])
    end = np.zeros(len(codes) + 1, dtype=bool)
    end[starts[1:-1]] = True
    bound = np.cumsum(end[:-1])
    for n in SIZES:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        inside = gap[n - 1 : n - 1 + count] - gap[1 : 1 + count]  # borders but for the first and the last character
        ok = (inside == 0) & (bound[n - 1 :] == bound[:count]) & (letter[:count] | letter[n - 1 :])
        at = np.nonzero(ok)[0]
        value = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(BASE) + lower[at + k]
        yield at, (mix(value) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: Logits that each bucket adds before averaging: embeddings times the linear layer.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Predictions below this calibrated probability aren't accepted.
    reject_below: float = 0.0

    def logits(self, texts) -> tuple[np.ndarray, np.ndarray]:
        codes, starts = char_codes(texts)
        total, seen = np.zeros((len(starts) - 1, len(self.languages))), np.zeros(len(starts) - 1)
        for at, bucket in subwords(codes, starts):
            each = self.table[bucket]
            cut = np.searchsorted(at, starts)
            some = np.nonzero(cut[1:] > cut[:-1])[0]
            if len(some):
                total[some] += np.add.reduceat(each, cut[some], axis=0, dtype=np.float64)
            seen += np.diff(cut)
        has_letter = per_text(letter_table()[codes], starts) > 0
        return total / np.maximum(seen, 1)[:, None] + self.bias, has_letter

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The language and its calibrated probability; ``und`` with probability 1 for a text without a letter.

        Of equally likely languages the first by name. A model that has learned no language says ``und`` with probability 0 of any other text.
        """
        if not self.languages:
            codes, starts = char_codes(texts)
            return np.full(len(starts) - 1, UNKNOWN, dtype=object), (per_text(letter_table()[codes], starts) == 0).astype(float)
        logits, has_letter = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return np.where(has_letter, np.array(self.languages, dtype=object)[best], UNKNOWN), np.where(has_letter, p[np.arange(len(p)), best], 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_language_model(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], calibrate: np.ndarray, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent over documents given as (buckets, counts); those flagged in ``calibrate`` set temperature and rejection.

    The temperature is the one with the least log loss on them. ``reject_below`` is the least probability from
    which predictions on them are right 99 times of 100.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=int)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, width))
    linear, bias = rng.normal(0, 0.1, (width, len(languages))), np.zeros(len(languages))
    learn = np.nonzero(~calibrate)[0] if (~calibrate).any() else np.arange(len(y))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            buckets, counts = bags[i]
            share = counts / counts.sum()
            hidden = share @ embed[buckets]
            error = _softmax((hidden @ linear + bias)[None, :])[0]
            error[y[i]] -= 1
            step = rate * (1 - done / steps)
            back = linear @ error
            linear -= step * np.outer(hidden, error)
            bias -= step * 0.1 * error
            embed[buckets] -= step * len(buckets) ** 0.5 * share[:, None] * back[None, :]
            done += 1
    model = LanguageModel(languages, (embed @ linear).astype(np.float32), bias)
    held = np.nonzero(calibrate)[0]
    if len(held):
        z = np.array([counts @ model.table[buckets] / counts.sum() for buckets, counts in (bags[i] for i in held)]) + bias
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
        p = _softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        order = np.argsort(-top, kind="stable")
        good = np.nonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(held) + 1))[0]
        model.reject_below = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def train_languages(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Fit on about ``per_language`` rows of each ``lang`` of ``docs (doc_id, text, lang)``, drawn by a hash of doc_id and text.

    Executors hash the subwords of whole texts, so the driver gets at most ``BUCKETS`` counts of a document.
    Rows with a null lang or text, or without a subword, are left out; if none is left, the model knows no language. Equal rows are drawn
    together, so copies weigh as often as they occur. A quarter of the rows calibrates.
    """
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit_language_model([], [], np.zeros(0, dtype=bool))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    drawn = known.where(F.shiftrightunsigned("h", 11) < share[F.col("lang")] * float(1 << 53))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, lang, h in zip(frame["text"], frame["lang"], frame["h"], strict=True):
                found = [b for _, b in subwords(*char_codes([text]))]
                buckets, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=int), return_counts=True)
                rows.append((h, lang, buckets.astype(np.int32), n.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["h", "lang", "buckets", "counts"])

    rows = drawn.select("text", "lang", "h").mapInPandas(run, "h long, lang string, buckets array<int>, counts array<int>").where(F.size("buckets") > 0).toPandas().sort_values(["h", "lang"])
    bags = [(np.asarray(b, dtype=np.int64), np.asarray(c, dtype=float)) for b, c in zip(rows["buckets"], rows["counts"], strict=True)]
    return fit_language_model(bags, rows["lang"].tolist(), (rows["h"] % 4 == 0).to_numpy())


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``accepted`` for every row, from the whole text alone.

    Without a letter (null and empty texts too): ``und``, score 1, not accepted. Otherwise a learned language with its
    calibrated probability (``und``, 0, not accepted if none was learned); ``accepted`` says whether that reaches the model's rejection
    bound. Equal rows get equal results, rows with a null doc_id keep it, other columns aren't read, and an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            lang, score = model.predict(part["text"])
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": lang, "score": score, "accepted": (lang != UNKNOWN) & (score >= model.reject_below)})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, accepted boolean")
