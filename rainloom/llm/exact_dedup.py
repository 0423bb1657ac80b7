"""Exact deduplication with a two-pass Bloom filter.

Pass 1 counts how often each bit position of the filter is hit (two positions a row, partial
counts before the shuffle) and keeps the positions hit twice or more as bitmaps.  Pass 2 tests
every row against them: a row with a position that was hit once is certainly unique and goes
straight through; only the others are shuffled, by the SHA-256 of their text.  Texts never
move in the map of duplicates: a row is its digest.

A filter has a fixed largest size (``MAX_BITS``: 32 MB), so broadcasting it is safe at every input
size.  More rows than it serves (MAX_BITS / BITS_A_ROW) are dealt by a hash of their digest into as
many parts as need a filter each: digests are written by part, without a shuffle, and the parts are
filtered one after the other, so one filter is broadcast at a time and none fills up.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shielded, text_of, unshielded, with_group
from .scratch import forget, keep, keep_each

MAX_BITS = 1 << 28
MIN_BITS = 1 << 20
BITS_A_ROW = 16
#: A filter row is one bitmap of so many bits, as bitmap_construct_agg makes them.
CHUNK = 15


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text_of(text)).cast("binary"), 256))


def filter_size(rows: int, max_bits: int = MAX_BITS) -> tuple[int, int]:
    """(bits, parts): a power of two from MIN_BITS to ``max_bits``, and how many such filters the rows need."""
    wanted = 1 << math.ceil(math.log2(max(1, rows * BITS_A_ROW)))
    return min(max_bits, max(min(MIN_BITS, max_bits), wanted)), max(1, wanted // max_bits)


def positions(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in (1, 2)]


def _bitmaps(hit: DataFrame) -> DataFrame:
    """Rows (chunk, bitmap) of positions p."""
    return hit.groupBy(F.shiftright("p", CHUNK).alias("chunk")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << CHUNK) - 1)).alias("bitmap"))


def repeat_filter(digests: DataFrame, bits: int, digest: str = "sha") -> DataFrame:
    """Rows (chunk, bitmap): the positions that at least two rows hit."""
    hit = digests.select(F.explode(F.array(*positions(F.col(digest), bits))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return _bitmaps(hit.filter("n > 1"))


def member_filter(digests: DataFrame, bits: int, digest: str) -> DataFrame:
    """Rows (chunk, bitmap): the positions that any row hits."""
    return _bitmaps(digests.select(F.explode(F.array(*positions(F.col(digest), bits))).alias("p")))


def probe(rows: DataFrame, bitmaps: DataFrame, bits: int, digest: str = "sha") -> DataFrame:
    """``rows`` with ``maybe``: whether every position of the digest is in the filter."""
    found = []
    for k, p in enumerate(positions(F.col(digest), bits)):
        rows = rows.withColumn("__p", p)
        rows = rows.join(F.broadcast(bitmaps.select(F.col("chunk").alias("__c"), F.col("bitmap").alias("__b"))), F.shiftright("__p", CHUNK) == F.col("__c"), "left")
        bit = F.col("__p").bitwiseAND((1 << CHUNK) - 1)
        byte = F.conv(F.hex(F.substring(F.col("__b"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        rows = rows.withColumn(f"__f{k}", F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop("__p", "__c", "__b")
        found.append(f"__f{k}")
    return rows.withColumn("maybe", F.col(found[0]) & F.col(found[1])).drop(*found)


def flagged(rows: DataFrame, digest: str, total: int, max_bits: int = MAX_BITS, only: bool = False) -> DataFrame:
    """The ``total`` rows of a kept table with ``maybe``, as a kept table; false for rows that are certainly unique.

    ``only``: just the others, without that column.
    """
    bits, parts = filter_size(total, max_bits)
    wanted = (lambda out: out.filter("maybe").drop("maybe")) if only else (lambda out: out)
    dealt = rows if parts == 1 else keep(rows.withColumn("__part", F.pmod(F.xxhash64(digest, F.lit(3)), F.lit(parts)).cast("int")), "dealt", "__part")

    def each():
        for part in range(parts):
            own = rows if parts == 1 else dealt.filter(F.col("__part") == part).drop("__part")
            bitmaps = keep(repeat_filter(own, bits, digest), "bloom")
            yield wanted(probe(own, bitmaps, bits, digest))
            forget(bitmaps)

    out = keep_each(each(), "flagged")
    if parts > 1:
        forget(dealt)
    return out


def divided(rows: DataFrame, ids: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``id_`` may be in the one column of ``ids``, and the rows for which it certainly is not.

    Only the first have to be joined to ``ids``: the others pass straight through.  Both have ``id_``
    still.  A filter of up to MAX_BITS decides; beyond some 17 million ids it lets more rows into
    the first part, which is right at any size.
    """
    bits, _ = filter_size(ids.count())
    bitmaps = keep(member_filter(ids, bits, ids.columns[0]), "ids-bloom")
    tested = probe(rows, bitmaps, bits, id_)
    return tested.filter("maybe").drop("maybe"), tested.filter("not maybe").drop("maybe")


def duplicate_map(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one.  Of equal
    texts the row with the largest doc_id stays; a null doc_id is smaller than any other, and of
    rows with the same text and doc_id exactly one stays.  Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    digests = keep(docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("sha"), F.monotonically_increasing_id().alias("uid")), "digests")
    rows = digests.count()
    tested = flagged(digests, "sha", rows, max_bits)
    forget(digests)
    possible = tested.filter("maybe").drop("maybe")
    groups = (
        possible.groupBy("sha")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("uid", "doc_id"), F.max("uid")).alias("keep_uid"))
        .filter("group_size > 1")
    )
    repeated = with_group(possible, keep(groups, "groups"), ["sha"], "group_size", rows)
    single = tested.filter("not maybe").drop("maybe").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast(tested.schema["doc_id"].dataType), "keep_uid": F.lit(None).cast("long")})
    alone = F.col("group_size").isNull()
    return repeated.unionByName(single).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter proves unique pass straight through; of the others only those with a
    doc_id that has a row to drop are joined to what is dropped.  The rules of ``duplicate_map``
    hold; of rows with the same text and doc_id any one stays.  Empty in, empty out.
    """
    docs, names = shielded(docs)
    doc_id, text = names[doc_id], names[text]
    digests = keep(docs.select(F.col(doc_id).alias("__id"), text_digest(text).alias("__sha")), "digests")
    rows = digests.count()
    possible = flagged(digests, "__sha", rows, only=True)
    groups = keep(possible.groupBy("__sha").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keep")).filter("__n > 1"), "groups")
    found = keep(with_group(possible, groups, ["__sha"], "__n", rows).filter("__n is not null"), "found")
    forget(digests, possible, groups)
    stays = F.col("__id").eqNullSafe(F.col("__keep"))
    gone = found.filter(~stays).select("__id", "__sha").distinct().withColumn("__stays", F.lit(False))
    twice = found.filter(stays).groupBy("__id", "__sha").count().filter("count > 1").select("__id", "__sha", F.lit(True).alias("__stays"))
    marked = keep(gone.unionByName(twice), "marked")
    forget(found)
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("?")))
    ids = keep(marked.select(F.xxhash64(F.coalesce(F.col("__id").cast("string"), F.lit("?"))).alias("__key")).distinct(), "ids")
    touched, rest = divided(docs.withColumn("__key", key), ids, "__key")
    touched = touched.withColumn("__text_sha", text_digest(text))
    joined = touched.join(marked, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha")), "left")
    once = joined.filter("__stays").dropDuplicates(["__sha", doc_id])
    return functools.reduce(DataFrame.unionByName, [unshielded(p, names) for p in (rest, joined.filter("__stays is null"), once)])
