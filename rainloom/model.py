"""The data model: long tables of (series keys, time, value), null for missing, units as metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ClimateSchema:
    """The canonical field names."""

    time: str = "time"
    latitude: str = "latitude"
    longitude: str = "longitude"
    precipitation: str = "precipitation"
    temperature: str = "temperature"
    surface_pressure: str = "surface_pressure"
    relative_humidity: str = "relative_humidity"
    specific_humidity: str = "specific_humidity"
    u_wind: str = "u_wind"
    v_wind: str = "v_wind"
    geopotential: str = "geopotential"

    def struct(self) -> T.StructType:
        names = [getattr(self, f) for f in self.__dataclass_fields__]
        return T.StructType([T.StructField(n, T.TimestampNTZType() if n == self.time else T.DoubleType()) for n in names])


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null, the only missing value from there on; all floating columns by default."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    out = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns or floating})
    for c in columns or floating:
        if df.schema[c].metadata:
            out = out.withMetadata(c, dict(df.schema[c].metadata))
    return out


def metadata(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata or {})


def with_metadata(df: DataFrame, column: str, **items: object) -> DataFrame:
    """``df`` with more metadata on a column; arithmetic drops it, so operators set it again."""
    return df.withMetadata(column, metadata(df, column) | items)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def series(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """The window of a series, in the order of time."""
    return Window.partitionBy(*keys).orderBy(*order)


def per_series(df: DataFrame, keys: Sequence[str], work, schema: str) -> DataFrame:
    """``work(pandas of one series) -> pandas`` for each series, keys first in the result."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    head = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    names = list(keys)

    def run(pdf):
        out = work(pdf)
        for n, k in enumerate(names):
            out.insert(n, k, pdf[k].iloc[0])
        return out

    grouped = df.groupBy(*keys) if keys else df.withColumn("__all", F.lit("")).groupBy("__all")
    return grouped.applyInPandas(run, f"{head}, {schema}" if head else schema)


def validate_dataset(df: DataFrame, *, required: Sequence[str] = (), require_cf_metadata: bool = False) -> DataFrame:
    """``df`` itself; a missing required column or, if asked, missing units of a coordinate raise."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {', '.join(missing)}")
    if require_cf_metadata:
        for c in ("latitude", "longitude"):
            if c in df.columns and not metadata(df, c).get("units"):
                raise ValueError(f"{c} has no CF units")
    return df


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """The condition that columns are equal in pairs, null to null; true without any."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def running_before(rows: DataFrame, value: str, order: str, bins: Column, within: Sequence[str] = (), name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group before them in ``order``, without a task for a whole group.

    ``bins`` is a number that does not fall as ``order`` rises.  Sums of bins are accumulated first;
    a window then runs inside each bin.
    """
    rows = rows.withColumn("__bin", bins)
    keys = [*within, "__bin"]
    earlier = Window.partitionBy(*within).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("__sum")).withColumn("__earlier", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__earlier")
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(sums, same(keys, [f"__k{i}" for i in range(len(keys))]))
    return joined.withColumn(name, F.col("__earlier") + F.col("__own")).drop("__bin", "__own", "__earlier", *[f"__k{i}" for i in range(len(keys))])


def describe_dataset(df: DataFrame, coordinates: Sequence[str] = ("time", "latitude", "longitude")) -> dict:
    """Sizes of the coordinates, the variables, the calendar and the history of normalisation."""
    dims = [c for c in coordinates if c in df.columns]
    row = df.agg(*[F.count_distinct(c).alias(c) for c in dims]).first() if dims else None
    history = [h for c in df.columns for h in metadata(df, c).get("history", [])]
    return {
        "dims": {c: row[c] for c in dims},
        "variables": [c for c in df.columns if c not in dims],
        "coords": dims,
        "calendar": metadata(df, "time").get("calendar", "standard") if "time" in df.columns else None,
        "feature_type": metadata(df, dims[0]).get("featureType") if dims else None,
        "normalization": list(dict.fromkeys(history)),
    }
