"""SimHash finds candidates of near_dedup on its own, and whole sets decide about them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orelode.llm import jaccard
from orelode.llm.simhash import fingerprints


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(draw.choices(words, k=600)) for _ in range(12)]
    texts += [t + " and so on" for t in texts]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fingerprints_find_near_copies_without_bands(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "_bucket_links", lambda batches: iter(()))
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    fps = fingerprints(texts, corpus_pipeline.NEAR_WORDS)[:, 0]
    near = [k for k in range(12) if int(fps[k] ^ fps[k + 12]).bit_count() <= corpus_pipeline.NEAR_DISTANCE]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert near and kept == set(range(24)) - {k + 12 for k in near}


def test_fingerprint_links_below_the_similarity_are_dropped(spark, docs):
    alike = jaccard.near_groups(docs, similarity=0.9999, distance=4).agg(F.countDistinct("root")).first()[0]
    assert alike == 24


def test_bands_find_what_fingerprints_miss(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "fingerprint_links", lambda each, distance: each.sparkSession.createDataFrame([], "a long, b long"))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(12))
