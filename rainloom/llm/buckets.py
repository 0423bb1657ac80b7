"""Links between the members of hash buckets, without pairing a bucket up.

Every member is compared with its bucket's leader, which connects a bucket of near copies, however
large, at one comparison for each.  What stays unconnected meets again by the rarest shingles of
each set (prefix filtering), which loses no similar pair: again first with a leader, and only then
in pairs of different components.  Of those pairs a bound on the overlap, from the places of the
common shingle and from bitmaps, leaves few to compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import forget, keep

#: Members of a key are paired up in blocks of so many, each block a group of its own.
BLOCK = 1024
#: Longs of a bitmap.
LONGS = 16


def shared_buckets(keys: DataFrame) -> DataFrame:
    """Rows (key, id, leader): the members of buckets (id, n, key) with two different ids or more.

    The leader is the member with the largest n, the least id if equal.  Buckets are found by partial
    aggregation, so no task gathers one.  A bucket of two is known by its least and greatest id;
    members of larger ones are found by a join, of which Spark splits the skewed keys.
    """
    found = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.max_by("id", "n").alias("top"))
    found = keep(found.filter("lo < hi"), "shared")
    twos = found.filter("m = 2").select("key", F.explode(F.array("lo", "hi")).alias("id"), F.when(F.col("most") > F.col("least"), F.col("top")).otherwise(F.col("lo")).alias("leader"))
    more = keep(keys.select("key", "id", "n").join(found.filter("m > 2").select("key", "most"), "key"), "more")
    leaders = keep(more.filter("n = most").groupBy("key").agg(F.min("id").alias("leader")), "leaders")
    members = keep(twos.unionByName(more.select("key", "id").join(leaders, "key").select("key", "id", "leader")), "members")
    forget(found, more, leaders)
    return members


def _in_open(members: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """``members`` with root, of the groups by ``by`` whose members are not all connected."""
    rooted = members.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    # Kept, so that both sides of the join are plain shuffles, which Spark splits where a key is hot.
    open_ = keep(rooted.groupBy(by).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(by), "open")
    return rooted.join(open_, by, "left_semi")


def _leader_pairs(members: DataFrame) -> DataFrame:
    return members.filter("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Rows (node, root): components of the pairs in a bucket that are similar.

    ``verify`` lets the similar ones of pairs (u, v) through; ``sets_of`` gives rows (id, shingles)
    of ids.  Ids that the leaders leave unconnected, often variants of one text that are like it
    but not similar, meet again by ``prefix_keys``.
    """
    first = keep(verify(_leader_pairs(members)), "first")
    roots = components(first)
    # Buckets of one leader mostly have the same members; together they are one group here.
    led = _leader_pairs(members).select(F.col("u").alias("id"), F.col("v").alias("leader"))
    rest = keep(_in_open(led, roots, "leader").select("id").distinct(), "rest")
    if rest.isEmpty():
        forget(first, rest)
        return roots
    sets = keep(sets_of(rest), "rest-sets")
    prefixes = keep(prefix_keys(sets, similarity), "prefixes")
    again = shared_buckets(prefixes)
    second = keep(similar(_apart(_leader_pairs(again), roots), sets, similarity), "second")
    # The stars of the links so far stand for them.
    roots = _joined(roots, second)
    left = keep(_in_open(prefixes.join(again.filter("id <> leader").select("key", "id"), ["key", "id"], "left_semi"), roots, "key"), "left")
    forget(rest, prefixes, again)
    if left.isEmpty():
        forget(sets, left, first, second)
        return roots
    third = keep(similar(close_pairs(left, sets, similarity), sets, similarity), "third")
    forget(sets, left, first, second)
    out = _joined(roots, third)
    forget(third)
    return out


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of more links (u, v) and those that ``roots``, which is forgotten, came from."""
    out = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
    forget(roots)
    return out


def close_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of rows (id, n, key, k, root) with a common key and different roots that may be similar.

    Sets of sizes a and b that are similar differ in at most (a + b) (1 - s) / (1 + s) members, and
    two bitmaps of the parity of their hashed members differ in no more places than the sets do in
    members: a pair whose bitmaps differ in more places is none.  The bound is exact.  A key with
    many members is dealt out in blocks, each of which meets all members of the key.
    """
    marked = left.join(bitmaps(sets, left), "id")
    sizes = keep(left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes")
    marked = marked.join(sizes, "key")
    columns = ("id", "root", "n", "k", *(f"w{i}" for i in range(LONGS)))
    a = marked.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = marked.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"b_{c}") for c in columns])
    total = F.col("a_n") + F.col("b_n")
    # The first member in common leaves enough after it for the overlap that similar sets have.
    after = F.least(F.col("a_n") - F.col("a_k"), F.col("b_n") - F.col("b_k")) + 1
    fits = after >= total * F.lit(similarity / (1 + similarity)) - 1e-9
    differ: Column = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(LONGS)), F.lit(0))
    near = differ <= total * F.lit((1 - similarity) / (1 + similarity)) + 1e-9
    same = (a["key"] == b["key"]) & (a["block"] == b["block"])
    return a.join(b, same & (F.col("a_root") < F.col("b_root")) & fits & near).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct()


def bitmaps(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (id, w0, w1, ...) of the sets whose id is in ``wanted``: the parity of hashed members by place, 64 places a column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, LONGS * 64), np.uint8)
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            hashed = np.asarray(batch.column(1).flatten()).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (LONGS * 64 - 1).bit_length())
            np.bitwise_xor.at(rows, (np.repeat(np.arange(len(sizes)), sizes), hashed.astype(np.int64)), 1)
            words = np.packbits(rows, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i].copy()) for i in range(LONGS))], ["id", *(f"w{i}" for i in range(LONGS))])

    return sets.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "shingles").mapInArrow(work, "id long, " + ", ".join(f"w{i} long" for i in range(LONGS)))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not connected yet."""
    for end in "uv":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.filter("ru <> rv").select("u", "v")


def prefix_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (id, n, key, k): the rarest members of each set, so many that similar sets share one.

    n is the size of the set and k the place of the member in it.

    Of sets of size n with Jaccard similarity s or more, the first n - ceil(s n) + 1 members in any
    common order have one in common.  In the order of rarity these are what sets a variant apart,
    so variants of a text that are not similar share none.
    """
    tokens = sets.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    often = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # Members of one set only are the rarest and come first: they are counted, and not ranked.
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "key")) - F.count(F.lit(1)).over(Window.partitionBy("id"))
    ranked = tokens.join(often, "key").withColumn("k", F.col("size") + place)
    most = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-9) + 1
    return ranked.filter(F.col("k") <= most).select("id", F.col("size").cast("long").alias("n"), "key", "k")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows (u, v) of ``pairs`` whose sets (id, shingles) have at least that Jaccard similarity."""
    left, right = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    # A pair of sizes that cannot reach the similarity is dropped before the sets are compared.
    both = pairs.join(left, "u").join(right, "v").filter(F.least(F.size("a"), F.size("b")) >= F.greatest(F.size("a"), F.size("b")) * similarity)
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common >= (F.size("a") + F.size("b") - common) * similarity).select("u", "v")
