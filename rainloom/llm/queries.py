"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, mixing, paragraph_dedup, pii, quality, sharding, simhash, token_counts
from .ranks import deal
from .scratch import keep
from .sql import SQL


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = paragraph_dedup.by_document(docs, paragraph_dedup.repeats(docs)).drop("text")
    spans = F.array_join(F.transform("removals", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    # A document's repeated paragraphs are its lines and its blocks; its removals are made of them.
    repeated = (F.col("n_repeated") + F.col("n_blocks") + F.col("n_own_blocks")).alias("n_repeated")
    return out.select("doc_id", "n_paragraphs", repeated, F.col("n_repeated").alias("n_repeated_lines"), "n_blocks", "n_own_blocks", F.size("removals").cast("long").alias("n_removed"), spans.alias("removed_spans"), F.array_distinct(F.transform("removals", lambda x: x["first_doc"])).alias("first_docs"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_map(documents(spark, sf_dir))


#: The layout that op9 starts from: so many shards, by a hash of doc_id.
OLD_SHARDS = 5
NEW_SHARDS = 8


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_wide_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.with_sizes(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", deal(F.col("doc_id"), OLD_SHARDS).cast("int").alias("old_shard"))
    out = sharding.reshard(rows, NEW_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(mixing.sized(documents(spark, sf_dir)).select("doc_id", "source", "size"), "sizes")
    out = mixing.systematic_mix(rows, rows.count())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files are; RAINLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("RAINLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(documents(spark, sf_dir))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    def added(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts, more = map(count, range(pii.BASE)), map(added, range(pii.BASE, len(pii.KINDS)))
    beside = (F.size("spans") - F.size(F.array_distinct("base"))).cast("long").alias("n_added")
    return out.select("doc_id", *counts, F.sha2(pii.spelled("base").cast("binary"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"), *more, beside, F.size("spans").cast("long").alias("n_spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_paragraph_dedup, op2_quality_rules, op3_bpe, op4_pii, op5_token_counts, op6_simhash, op7_exact_dedup, op8_line_dedup, op9_resharding, op10_mixing)}
__all__ = ["QUERIES", "SQL"]
