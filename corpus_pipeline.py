"""The corpus pipeline: documents to packed sequences, each stage one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import materialize, read_table
from orelode.llm.decontaminate import drop_contaminated
from orelode.llm.jaccard import near_groups
from orelode.llm.packing import pack_documents
from orelode.llm.quality import keep_good, train_quality
from orelode.llm.queries import CAPACITY, END_ID, tokenizer_path
from orelode.llm.simhash import keep_one
from orelode.llm.substring_dedup import drop_repeats

#: Near-duplicates share at least so much of their sets of shingles of five words; fingerprints that link differ in so many bits at most.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_DISTANCE = 5, 0.8, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees, with all their columns.

    Null and empty texts have no words and go. Equal texts are judged alike, whatever else a row holds; repeated rows and null doc_ids
    stay as they are. Without a usable label the trees say 0.5 of every text, so the base rules decide alone. No documents give none.
    """
    return keep_good(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, with all its columns: least doc_id (a null one last), then least digest of the text.

    Candidates come from SimHash fingerprints, as in ``op10``, and from MinHash bands where these are too far apart; whole sets of shingles decide.
    Of rows with equal doc_id and text one stays; rows with equal doc_id and other texts are documents of their own. Null texts and texts
    without a word are near-duplicates of each other. No documents give none.
    """
    return keep_one(docs, near_groups(docs, NEAR_WORDS, NEAR_SIMILARITY, NEAR_DISTANCE))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier one has (by doc_id, a null one last); those left without a word go.

    ``text`` and ``n_chars`` (then its code points) change, other columns stay, one called ``removed`` too. Rows with equal doc_id take nothing
    from each other, so repeated rows stay alike. Null and empty texts have no word and go. No documents give none.
    """
    kept = drop_repeats(docs.withColumnRenamed("removed", "__removed")).drop("removed").withColumnRenamed("__removed", "removed")
    return kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns.

    Items with a null item_id count, those with a null or empty text don't; an empty benchmark lets all pass. Null and empty texts hold
    nothing and stay, repeated rows are judged alike. No documents give none.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; other columns than doc_id and text aren't read.

    A null or empty text is one piece of the end id alone. Repeated rows are packed each, null doc_ids stay null. No documents give none.
    """
    return pack_documents(docs, tokenizer_path(), CAPACITY, END_ID, emit="ids_crc32")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Models, fingerprints and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
