"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be taken e = target / size of the source times.  The
expected copies are summed along the source (rank * e, since e is one number for a source), one
random offset of the source is added, and a document is emitted once for every integer that the
sum crosses at it.  Within a source the order is by size, so that the error of the words taken
stays within about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded, text_of, unshielded, word_count
from .ranks import deal, deals, ranked, size_class

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources by code point, null last, have the repeated ``weights`` and share ``share`` of all
    sizes.  No target is above ``limit`` times its source's size; what is cut off is shared again
    by weight.  That is water-filling: target = least(limit * size, level * weight), where the
    level is the largest of those that hold after the sources with the smallest limit a weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    earlier, later, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(later)
    return weighed.withColumn("level", level).withColumn("level", F.max("level").over(every)).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random offset of a source, from 0 to 1: 32 bits of the MD5 of seed and source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("?"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_mix(rows: DataFrame, count: int, doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """``rows``, which have source and size, with source_size, target and copies.

    ``count``: the number of rows, which sets how finely a hot source is dealt into bins.  A null
    source is a source; a null doc_id sorts first; repeated rows are rows of their own.  Sources
    without a word have target 0 and no copies.  Reruns take the same documents.  Columns named
    like the results are replaced; empty in, empty out.
    """
    rows = rows.drop("source_size", "target", "copies")
    targets = source_targets(rows.select("source", "size"), weights, share, limit)
    binned = rows.withColumn("__class", size_class(F.col("size"))).withColumn("__deal", deal(F.col(doc_id), deals(count)))
    out = ranked(binned, ["source"], ["__class", "__deal"], [F.col("size"), F.col(doc_id)], "__rank", extra=targets)
    each = F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(F.col("__rank") * each + u) - F.floor((F.col("__rank") - 1) * each + u)
    return out.withColumn("copies", copies.cast("long")).drop("__class", "__deal", "__rank")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size: the words of the text, null 0."""
    return docs.withColumn("size", word_count(text_of(text)))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of ``docs``."""
    rows, names = shielded(docs)
    rows = sized(rows, names[text]).withColumn("source", F.col(names[source]))
    mixed = systematic_mix(rows, docs.count(), names[doc_id]).filter("copies > 0")
    return unshielded(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)
