"""The registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import crc_mod, read_table

#: The rules of the url query: host, path, verdict (fixed values of its contract).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Shards 0 to 15 of equal weight.
SHARD_WEIGHTS = [1.0] * 16


#: The vocabulary and the limits of the packing query (fixed values of its contract).
VOCABULARY, CAPACITY, END_ID = "byte_bpe_50k.json", 1024, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.langid import identify_languages, train_languages

    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train_languages(docs.where(~held).select("doc_id", "text", "lang"))
    found = identify_languages(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.html_text import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.substring_dedup import drop_repeats

    kept = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.quality import judge_quality, train_quality

    docs = read_table(spark, sf_dir, "documents")
    return judge_quality(docs, train_quality(docs, read_table(spark, sf_dir, "labels"))).drop("text_hash")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.toxicity import score_toxicity, train_toxicity

    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = train_toxicity(docs, read_table(spark, sf_dir, "labels").where(~held))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.decontaminate import find_passages

    return find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.sharding import shard_records

    placed = shard_records(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_WEIGHTS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY, END_ID, emit="ids_crc32")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orelode.llm.simhash import simhash_groups

    groups = simhash_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, distance=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_main_text": op2_main_text,
        "op3_url_filter": op3_url_filter,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality": op5_quality,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_rendezvous_shards": op8_rendezvous_shards,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
    }


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP3_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT p.*, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC NULLS LAST, r_verdict = 'block' DESC, r_host || r_path DESC) AS k
  FROM parts p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL}
