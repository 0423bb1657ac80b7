"""Removal of lines that many sites share, with DataFrame functions only.

The spread of a line is the number of distinct sites that have it.  A HyperLogLog sketch of the
sites is built for each line hash and merged by aggregation, so a line on every page is one small
row for each task.  The sketch decides where its estimate is clear of the limit; lines within
BAND of it (six standard errors) get an exact distinct count.  Removals go back to the documents
by line hash; only lines that are removed take part in the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of, with_group
from .exact_dedup import divided
from .scratch import keep

MIN_SITES = 8
#: log2 of a sketch's size: standard error 1.04 / 2 ** 6.
LOG_SIZE = 12
#: Estimates within this share of the limit, and one more site, are near it.
BAND = 0.1


def site_key(site: str) -> Column:
    """The site as a value; null is a site of its own."""
    return F.when(F.col(site).isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), F.col(site)))


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Rows (doc_id, text_hash, site, at, h1, h2): the lines with a word, by two 64-bit hashes."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), site_key(site).alias("site"))
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.filter(F.col("line").rlike(WORD)).select("doc_id", "text_hash", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def wide_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (h1, h2, n): lines on at least ``min_sites`` sites, with how often they occur."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_SIZE)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    # A line on so many sites occurs as often.
    spread = keep(sketches.filter(F.col("n") >= min_sites).select("h1", "h2", "n", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    margin = BAND * min_sites + 1
    clear = spread.filter(F.col("sites") > min_sites + margin)
    near = spread.filter(F.col("sites").between(min_sites - margin, min_sites + margin))
    pairs = with_group(lines.select("h1", "h2", "site"), near, ["h1", "h2"], "n", lines.count()).filter("n is not null")
    exact = pairs.select("h1", "h2", "n", "site").distinct().groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return clear.select("h1", "h2", "n").unionByName(exact.select("h1", "h2", "n"))


def remove_wide_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed and the cleaned text.

    Lines are cut at \\n and compared exactly; lines without a word neither count nor go.  A null
    text is empty, a null site is a site, repeated rows of a document are on one site.  Other
    columns are ignored, whatever their names; empty in, empty out.
    """
    lines = keep(lines_of(docs, doc_id, text, site), "lines")
    wide = keep(wide_lines(lines, min_sites), "wide")
    hits = with_group(lines, wide, ["h1", "h2"], "n", lines.count()).filter("n is not null")
    gone = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "gone")
    gone = keep(gone, "gone")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("__h", F.xxhash64("text"))
    # Texts without a line to remove, which are most, pass straight through.
    hit, rest = divided(rows, keep(gone.select("__hash").distinct(), "hit"), "__h")
    hit = hit.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left").drop("__id", "__hash")
    rows = hit.unionByName(rest.withColumn("gone", F.lit(None).cast("array<int>")))
    rows = rows.select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # What stays are the slices between the places removed; each line is looked at once.
    rows = rows.withColumn("cuts", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))))
    cut = lambda k: F.get(F.col("cuts"), k)
    slices = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", cut(k) + 2, cut(k + 1) - cut(k) - 1))
    return rows.select(
        "doc_id",
        F.size(F.filter("lines", lambda x: x.rlike(WORD))).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join(F.flatten(slices), "\n").alias("text"),
    )
