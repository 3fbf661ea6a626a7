"""Substring dedup by hashing lines and sentences: the earliest occurrence of a unit stays, later ones go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import char_codes, materialize, slabs, small_batches, text_hash
from orelode.llm.spans import lower_table, mix, owner, runs, span_digests, white, word_character_table

#: A unit is told by so many words at least: its own, and if it has fewer, those of the units after it.
MIN_WORDS = 8
#: A whole line or sentence is a unit of its own from so many words.
WHOLE_WORDS = 3
#: Lines and sentences of more words are also cut after words whose digest is divisible by CUT.
MOST_WORDS, CUT = 10, 5


def text_units(texts, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end, digest) of every unit of every text; the offsets count code points in the text.

    A line is parted after the white space that follows ``.``, ``!`` or ``?``; long parts are cut further, at places
    that depend on the words alone. A unit is a part, or, if it has fewer than ``min_words`` words, as many parts as make them
    up; where the text ends before, they are made up by the parts in front, and a text of fewer words is a unit as a whole.
    Each line and sentence of WHOLE_WORDS or more words is a unit too, whatever follows. Units may overlap, but no two are of
    the same words in the same place. The digest covers lower-cased runs of letters and numerals only, so case, white space and
    punctuation don't matter.
    """
    codes, starts = char_codes(texts)
    wb, we = runs(word_character_table()[codes], starts)
    words = span_digests(lower_table()[codes], wb, we)
    first = np.zeros(len(codes) + 2, dtype=bool)
    blank, stop = white(codes), (codes == 46) | (codes == 33) | (codes == 63)
    first[1:-1] = codes == 10
    first[starts[:-1]] = True
    lines = first.copy()
    if len(codes) > 1:
        first[2:-1] |= blank[1:] & stop[:-1]

    def ranges(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b = np.nonzero(first[: len(codes)])[0]
        e = np.append(b[1:], len(codes))[: len(b)]
        return b, e, np.searchsorted(wb, b), np.searchsorted(wb, e)

    units = [[x[w1 - w0 >= WHOLE_WORDS] for x in (b, e, w0, w1)] for b, e, w0, w1 in (ranges(lines), ranges(first))]
    b, e, w0, w1 = ranges(first)
    long = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(long, w0[w1 - w0 > MOST_WORDS], 1)
    np.add.at(long, w1[w1 - w0 > MOST_WORDS], -1)
    inside = np.cumsum(long)[:-1] > 0
    cut = np.nonzero((words[:-1] % np.uint64(CUT) == 0) & inside[:-1] & inside[1:])[0] + 1 if len(words) else []
    first[wb[cut]] = True
    b, e, w0, w1 = ranges(first)
    of = owner(starts, b)
    reach = np.searchsorted(w1, w0 + min_words)
    known = (w1 > w0) & (reach < len(b))
    known[known] &= of[reach[known]] == of[known]
    units.append([b[known], e[reach[known]], w0[known], w1[reach[known]]])
    # What is left at a text's end goes back to the last part from which there are enough words, or to the text's begin.
    final = np.nonzero(np.append(of[1:] != of[:-1], True))[0] if len(of) else np.zeros(0, dtype=np.int64)
    head = np.searchsorted(of, of[final])
    back = np.maximum(np.searchsorted(w0, w1[final] - min_words, side="right") - 1, head)
    some = w1[final] > w0[back]
    final, back = final[some], back[some]
    units.append([b[back], e[final], w0[back], w1[final]])
    b, e, w0, w1 = (np.concatenate(x) for x in zip(*units, strict=True))
    one = np.lexsort((-e, b, w1, w0))  # of units of the same words the widest
    one = one[np.append(True, (np.diff(w0[one]) != 0) | (np.diff(w1[one]) != 0))] if len(one) else one
    b, e, w0, w1 = b[one], e[one], w0[one], w1[one]
    of = owner(starts, b)
    return of, b - starts[of], e - starts[of], span_digests(words, w0, w1)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans, which have to be sorted and may overlap."""
    parts, at = [], 0
    for b, e in spans:
        parts.append(text[at:b])
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _unit_frames(min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "text"):
            of, begin, end, digest = text_units(part["text"], min_words)
            first = np.zeros(len(of), dtype=bool)
            first[np.unique(digest + mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = True
            span, digest, rows = begin << 32 | end, digest.view(np.int64), np.arange(len(part) + 1)
            own, more = np.searchsorted(of[first], rows), np.searchsorted(of[~first], rows)
            lists = lambda x, at: [x[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text_hash": part["text_hash"].to_numpy(), "digest": lists(digest[first], own), "span": lists(span[first], own), "again": lists(span[~first], more)})

    return run


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``spans`` (sorted ``begin, end``) of what is to go, for rows that have any.

    A unit goes if its digest occurs earlier in its document, or in a document with a smaller doc_id (a null one comes last).
    Rows with equal doc_id don't take from each other. Only digests and numbers are shuffled; a digest that a third of all
    documents hold is aggregated before the shuffle, and joined from a written table, so Spark can split it.
    """
    small_batches(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), "text", text_hash().alias("text_hash"))
    # A span is begin * 2^32 + end: one number to shuffle. ``again`` holds a document's own repeats.
    packed = materialize(rows.mapInPandas(_unit_frames(min_words), "doc_id long, text_hash long, digest array<long>, span array<long>, again array<long>"), "units")
    holders = packed.select("doc_id", F.explode("digest").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialize(holders.where("low < high").select("digest", "low"), "shared")
    # Only where a doc_id has several texts does the text's digest travel with each unit.
    texts = packed.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.max("text_hash").alias("other"))
    names = ["doc_id", "text_hash"] if texts.where("text_hash <> other").limit(1).count() else ["doc_id"]
    units = packed.select(*names, F.explode(F.arrays_zip("digest", "span")).alias("u")).select(*names, "u.*")
    elsewhere = units.join(shared, "digest").where("doc_id > low").select(*names, "span")
    gone = elsewhere.unionAll(packed.select(*names, F.explode("again").alias("span")))
    pairs = F.transform(F.array_sort(F.collect_set("span")), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("begin"), x.bitwiseAND((1 << 32) - 1).cast("int").alias("end")))
    spans = gone.groupBy(*names).agg(pairs.alias("spans"))
    if len(names) == 1:
        spans = spans.join(texts.select("doc_id", "text_hash"), "doc_id").select("doc_id", "text_hash", "spans")
    return spans.withColumn("doc_id", F.when(F.col("doc_id") < last, F.col("doc_id")))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with what stays of each ``text``, and ``removed``: the spans that went, as offsets in the original.

    All columns and rows stay (a column called ``removed`` is replaced); a null text stays null and an empty one empty. Equal
    rows get equal results. Spans may overlap.
    """
    spans = materialize(repeated_units(docs, min_words), "spans").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__key", text_hash())
    met = keyed.join(spans, keyed["doc_id"].cast("long").eqNullSafe(spans["__id"]) & (keyed["__key"] == spans["__hash"]), "left")

    @F.pandas_udf("string")
    def rest(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if b is None or t is None else cut_out(t, list(zip(b, e, strict=True))) for t, b, e in zip(text, begins, ends, strict=True)], dtype=object)

    kept = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest("text", F.col("__spans.begin"), F.col("__spans.end")))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return met.select(*[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed"], F.coalesce("__spans", none).alias("removed"))
