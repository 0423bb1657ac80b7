"""A pipeline over documents: good, unique, mixed to target weights and encoded.

Each stage works on all that its predecessor kept.  The first four return rows with the columns
of documents; the mix repeats the rows that it takes more than once.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from rainloom.llm import bpe, exact_dedup, mixing, near_copies, quality
from rainloom.llm.queries import vocabulary_path
from rainloom.llm.scratch import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, on hosts that are not rejected."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document is there once for each copy taken."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of the text they decode to."""
    return bpe.encode_documents(docs, vocabulary_path(), outputs=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("bpe encoding", encode),
]

#: SQL has neither SimHash components nor BPE; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    docs = functools.reduce(lambda d, stage: keep(stage[1](spark, d, sf_dir), "stage"), first, docs)
    return last(spark, docs, sf_dir)
