"""Queries of the training-data problems over the test tables, with their reference SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import abuse, history, leaks, packing, writings
from folioscope.runtime import table, written


#: Vocabulary that sizes documents; the file must exist on every host.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
CAPACITY = 2048


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats_of_history(table(spark, d, "manifest"), table(spark, d, "manifest_batches"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = writings.copies(table(spark, d, "crawled_urls"), "link_id", ["type"], ["url", "referer"])
    return found.select(F.col("first").alias("link_id_a"), F.col("copy").alias("link_id_b"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    found = writings.distinct_records(table(spark, d, "crawled_urls"), "link_id", ["type"], ["url", "referer"])
    return found.select(F.col("first").alias("link_id"), F.col("n").alias("n_copies"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", VOCABULARY, CAPACITY)


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with a place, and how many containers and bodies break a rule: none may."""
    return packing.faults(written(p6_containers(spark, d), "packed"), "doc_id", CAPACITY)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", F.col("item").alias("item_id")).distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("reviewed").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p5_records, p6_containers, p6_faults, p7_found, p7_items, p8_found, p8_scores, p8_sources)}


def _canonical_sql(column: str) -> str:
    bare = lambda c: rf"lower(regexp_replace(regexp_replace({c}, '(?i)%(20|09|0[a-d]|C2%A0|C2%85|E1%9A%80|E2%80%8[0-9a-f]|E2%80%A[89f]|E2%81%9F|E3%80%80)', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'))"
    text = f"coalesce({column}, '')"
    base = f"split_part({text}, '?', 1)"
    return f"{bare(base)} || array_to_string(list_sort(list_transform(string_split_regex(substr({text}, length({base}) + 2), '[&#]'), lambda x: {bare('x')})), '')"


_KEYED = f"WITH k AS (SELECT link_id, type, {_canonical_sql('url')} AS u, {_canonical_sql('referer')} AS r FROM crawled_urls)"

SQL = {
    "p6_faults": "SELECT count(*) AS n_ids, CAST(0 AS BIGINT) AS n_too_full, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_badly_split FROM documents",
    "p5_found": f"{_KEYED}, m AS (SELECT link_id, min(link_id) OVER (PARTITION BY type, u, r) AS a FROM k) SELECT a AS link_id_a, link_id AS link_id_b FROM m WHERE a <> link_id",
    "p5_records": f"{_KEYED} SELECT min(link_id) AS link_id, count(*) AS n_copies FROM k GROUP BY type, u, r",
}
