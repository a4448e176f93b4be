"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausal.llm import bpe, chat, jaccard_join, line_dedup, mixing, oracle, pii, repetition, search, toxicity, url_filter
from clausal.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and where each document enters the training mix."""
    report = mixing.mix_report(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return report.withColumn("target", F.round("target", 3)).select("doc_id", "size", "source_size", "target", "taken")


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document with an id divisible by 100, by its whole text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return search.top_k(docs, docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), k=10)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", r"r'\### Assistant: </turn> ok' as text")
    return chat.formatted(turns.unionByName(planted))


#: Written URL rules: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; pages of low-quality documents are the examples to block."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id as page_id", "1 - quality as blocked")
    out = url_filter.judged(table(spark, sf_dir, "pages", "page_id", "url"), labels, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts of all documents, as digests."""
    return bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digest of its text after line deduplication."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_gone", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and the verdict of every document."""
    return repetition.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: three-word shingles, a similarity of 0.9 or more."""
    groups = jaccard_join.link_groups(table(spark, sf_dir, "documents", "doc_id", "text"), percent=90, k=3)
    return groups.select("doc_id", "n_shingles", "component_id")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_pii that SQL can express: the base spans."""
    return op1_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_url_filter that SQL can express: hosts, paths and written rules."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def base_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_repetition that SQL can express: the base measures."""
    return op9_repetition(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_search": op4_search,
    "op5_chat": op5_chat,
    "op6_url_filter": op6_url_filter,
    "op7_bpe": op7_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_repetition": op9_repetition,
    "op10_jaccard_join": op10_jaccard_join,
    "base_pii": base_pii,
    "base_url_rules": base_url_rules,
    "base_repetition": base_repetition,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op10_jaccard_join": oracle.NEAR_GROUPS,
    "base_pii": oracle.PII_BASE,
    "base_url_rules": oracle.URL_RULES,
    "base_repetition": oracle.REPETITION_BASE,
}
