"""A corpus pipeline over `documents`: from raw rows to token ids of a training sequence.

toxicity        documents that the model rejects go
line_dedup      passages that an earlier document has go; documents left empty by it go
near_duplicates one document of each group of near duplicates stays
mixing          documents enter the training sequence as often as their source's target says
bpe             every text of the sequence is encoded and decoded

Each stage returns a frame that is written as Parquet to the shared folder and read again,
so that a lost executor costs one stage's tasks at most. All stages but the last keep the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausal.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from clausal.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the toxicity threshold; the model learns from labels that aren't held out."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.filter("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without blocks of lines that an earlier document has."""
    return line_dedup.dedup_lines(docs, drop_emptied=True).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return jaccard_join.keep_one(docs, percent=80, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents repeated and ordered by the mix."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every row."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
