"""Host-level quality rules, with DataFrame functions only.

Each document is measured and tested against the base rules.  Failures are added up for each
host, the failure rate of a host is shrunk towards all hosts by a beta prior that is fitted to the
hosts themselves (method of moments), and hosts whose shrunk rate is above a limit are rejected
with all their documents.  The verdict is joined back; a host with a thousandth of all rows is
heavy (``common.HEAVY``) and its rows are not shuffled for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, shielded, text_of, unshielded, with_group
from .scratch import keep

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when so large a share of its documents fails, after shrinkage.
MAX_HOST_RATE = 0.8
#: Bounds of the prior's weight in documents, for hosts that differ not at all or wholly.
PRIOR = (1.0, 1e6)


def measures(text: Column) -> dict[str, Column]:
    """The expressions of ``measured`` that need no step between."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    out = docs.withColumn("__t", text_of(text))
    out = out.withColumns({"__w": F.array_remove(F.split("__t", SPACE), ""), **measures(F.col("__t"))})
    out = out.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
    # Windows are compared by 64-bit hash and sorted with their places; one equal to a neighbour is
    # repeated, and the places in order cover up to three words each.  All but the sort is linear.
    out = out.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w))).drop("__w", "__t")
    at = lambda i: F.get(F.col("__h"), i)
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn("__s", F.when(F.col("n_words") >= 3, F.sort_array(windows))).drop("__h")
    s = F.col("__s")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    out = out.withColumn("__p", places).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows (host, host_docs, host_failed, host_rate, host_rejected) from rows with base_failed.

    The prior has the mean m of all documents and a weight s with m (1 - m) / (s + 1) equal to
    the variance between hosts that chance does not explain.  A null host is a host.
    """
    hosts = keep(rows.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    n, k = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n), F.sum(k), F.count(n)).first()
    if not total[0]:
        return hosts.withColumns({"host_rate": F.lit(0.0), "host_rejected": F.lit(False)})
    m = total[1] / total[0]
    spread = hosts.agg(F.sum(n * (k / n - m) * (k / n - m))).first()[0] / total[0]
    between = spread - m * (1 - m) * total[2] / total[0]
    weight = PRIOR[1] if between <= 0 else min(PRIOR[1], max(PRIOR[0], m * (1 - m) / between - 1))
    rate = (k + F.lit(m * weight)) / (n + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judged(rows: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``rows``, which have base_failed, with host_rejected and kept."""
    verdicts = host_verdicts(rows, host, max_rate).select(host, "host_docs", "host_rejected")
    out = with_group(rows, verdicts, [host], "host_docs", rows.count()).drop("host_docs")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, host, the measures, base_failed, host_rejected, kept.

    Null texts are empty: no words, so base_failed.  A null host counts as one host.  Repeated
    rows are counted as often as they occur.  Other columns are ignored; empty in, empty out.
    """
    rows = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))).drop("text")
    return judged(keep(rows, "measured"), "host")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the measures are taken once."""
    rows, names = shielded(docs)
    rows = measured(rows, names[text]).select(*names.values(), "base_failed")
    return unshielded(judged(keep(rows, "measured"), names[host]).filter("kept"), names)
