"""Ranks and running sums within groups, without one task for a whole group.

Rows are dealt into bins that are small and ordered within their group.  Counts per bin are few
and are accumulated first; the rest of a rank is counted inside the bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deals(rows: int) -> int:
    """By how many hash values a bin is split: the square root, so neither bins nor their number get large."""
    return max(1, math.ceil(math.sqrt(rows / 1000)))


def deal(key: Column, parts: int) -> Column:
    """A hash of the key from 0 to parts - 1, the same in any engine (from MD5)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts))


def size_class(size: Column) -> Column:
    """A class of sizes that differ by under 1/64, in the order of the sizes; exact integers."""
    shift = F.greatest(F.char_length(F.bin(size)) - 7, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", size, shift)).cast("long")


def ranked(rows: DataFrame, group: list[str], bins: list[str], order: list[Column], name: str = "rank", value: Column | None = None, extra: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``name``: the 1-based rank within ``group`` by (``bins``, ``order``).

    ``value``: the running sum of that instead, without the row's own.  ``extra``: columns for
    each group, attached on the way.  Nulls in keys are keys of their own.  Every row is shuffled
    once, by group and bin.
    """
    keys = [*group, *bins]
    counted = rows.groupBy(*keys).agg((F.count(F.lit(1)) if value is None else F.sum(value)).cast("long").alias("__n"))
    before = Window.partitionBy(*group).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if extra is not None:
        names = [c for c in extra.columns if c not in group]
        held = extra.select(*[F.col(g).alias(f"__g_{g}") for g in group], *names)
        on = F.lit(True)
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        offsets = offsets.join(held, on, "left").drop(*[f"__g_{g}" for g in group])
    offsets = offsets.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    own = F.row_number().over(inside) if value is None else F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(offsets, on).withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__own", "__before", *[f"__k_{k}" for k in keys])
