"""Column expressions and joins that several operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A group with at least 1/HEAVY of all rows is heavy, so there are at most HEAVY of them.
HEAVY = 1000


def text_of(column: str) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does that for pure ASCII and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to one row per key of ``groups``, safe for heavy keys and for null keys.

    ``size`` is a column of ``groups``: how many of the ``total`` rows have the key.  The heavy
    groups number at most ``HEAVY`` whatever the input, so they are broadcast and their rows stay
    where they are; all other keys have under 1/HEAVY of the rows each, and are shuffled.
    """
    heavy = groups.filter(F.col(size) * HEAVY >= total)
    light = groups.filter(F.col(size) * HEAVY < total)
    names = [c for c in groups.columns if c not in keys]

    def on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *names)
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = left.join(right, condition, how)
        return out if how == "left_anti" else out.drop(*[f"__{k}" for k in keys])

    return on(rows, F.broadcast(heavy), "inner").unionByName(on(on(rows, F.broadcast(heavy), "left_anti"), light, "left"))


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named __d0, __d1 and so on, which no operator uses, and each one's new name."""
    names = {c: f"__d{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unshielded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns of the shielded table, under their own names."""
    return df.select(*[F.col(v).alias(k) for k, v in names.items()])


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of the batches: what a worker holds as Python objects does not grow with a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, after which the worker gives freed memory back: it stays beside the stages to come, idle."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
