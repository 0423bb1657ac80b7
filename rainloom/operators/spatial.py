"""Area weights, regional means, longitudes and regridding on rectilinear grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import ratio


def normalize_longitude(df: DataFrame, *, lon: str = "longitude", target: str | None = None, center: float = 0.0) -> DataFrame:
    return df.withColumn(lon, scalars.longitude(F.col(lon), target=target, center=center)).orderBy(lon)


def normalize_latitude(df: DataFrame, *, lat: str = "latitude", ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(lat).asc() if ascending else F.col(lat).desc())


def cosine_latitude_weights(df: DataFrame, *, lat: str = "latitude") -> DataFrame:
    """Rows (lat, weight) by latitude, with mean 1 over the latitudes."""
    out = df.select(lat).distinct().withColumn("weight", scalars.cosine_weight(F.col(lat)))
    return out.withColumn("weight", F.col("weight") / F.avg("weight").over(Window.partitionBy()))


def area_weighted_mean(df: DataFrame, *, value: str = "value", lat: str = "latitude", keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Rows (keys, mean) weighted by the cosine of latitude; missing cells count in neither sum."""
    w = scalars.cosine_weight(F.col(lat))
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w))).alias(name))


def regional_mean(df: DataFrame, *, value: str = "value", time: str = "time", lat: str = "latitude", lon: str = "longitude", weights: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, time, value): the weighted mean over all cells; ``weights`` are rows (lat, lon, weight)."""
    if weights is None:
        return area_weighted_mean(df, value=value, lat=lat, keys=[*keys, time])
    weighed = df.join(weights, [lat, lon])
    w = F.col("weight")
    return weighed.groupBy(*keys, time).agg(ratio(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w))).alias("value"))


def axis_brackets(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """Rows (target, low, high, part): the source coordinates around each target one.

    Coordinates of an axis are a dimension: as-of by one window over both, never a pair of all.
    Targets outside the source have none.
    """
    points = source.select(F.col(axis).alias("x")).distinct().withColumns({"s": F.col("x"), "t": F.lit(None).cast("double")})
    wanted = target.select(F.col(axis).alias("x")).distinct().withColumns({"s": F.lit(None).cast("double"), "t": F.col("x")})
    both = points.unionByName(wanted)
    order = Window.orderBy("x")
    low = F.max("s").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.min("s").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    out = both.withColumns({"low": low, "high": high}).filter("t is not null and low is not null and high is not null")
    return out.select(F.col("t").alias("target"), "low", "high", F.coalesce(ratio(F.col("t") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)).alias("part"))


def regrid(df: DataFrame, target: DataFrame, *, method: str = "linear", value: str = "value", lat: str = "latitude", lon: str = "longitude", keys: Sequence[str] = ("time",)) -> DataFrame:
    """Rows (keys, lat, lon, value) on the cells of ``target`` (rows lat, lon).

    linear: bilinear, null if a corner is missing; nearest: the lower of two equally near;
    conservative: the mean weighted by the overlap of cells, which end halfway between centres.
    Cells outside the source have no row.
    """
    if method == "conservative":
        return _conservative(df, target, value, lat, lon, keys)
    if method not in ("linear", "nearest"):
        raise ValueError("method must be 'linear', 'nearest' or 'conservative'")
    corners = []
    for axis in (lat, lon):
        around = axis_brackets(df, target, axis)
        if method == "nearest":
            one = around.select("target", F.when(F.col("part") <= 0.5, F.col("low")).otherwise(F.col("high")).alias("source"), F.lit(1.0).alias("w"))
        else:
            low = around.select("target", F.col("low").alias("source"), (1 - F.col("part")).alias("w"))
            high = around.filter("part > 0").select("target", F.col("high").alias("source"), F.col("part").alias("w"))
            one = low.unionByName(high)
        corners.append(one.select(F.col("target").alias(axis), F.col("source").alias(f"__{axis}"), F.col("w").alias(f"__w_{axis}")))
    cells = target.select(lat, lon).distinct().join(corners[0], lat).join(corners[1], lon)
    source = df.select(*keys, F.col(lat).alias(f"__{lat}"), F.col(lon).alias(f"__{lon}"), F.col(value).alias("__v"))
    parts = source.join(cells, [f"__{lat}", f"__{lon}"])
    w = F.col(f"__w_{lat}") * F.col(f"__w_{lon}")
    whole = (F.count(F.lit(1)) == F.count("__v")) & (F.sum(w) > 1 - 1e-9)
    return parts.groupBy(*keys, lat, lon).agg(F.when(whole, F.sum(F.col("__v") * w)).alias(value))


def _edges(df: DataFrame, axis: str) -> DataFrame:
    order = Window.orderBy(axis)
    points = df.select(axis).distinct()
    before, after = F.lag(axis).over(order), F.lead(axis).over(order)
    x = F.col(axis)
    half_low, half_high = (x - before) / 2, (after - x) / 2
    # A lone coordinate stands for one degree.
    return points.select(axis, (x - F.coalesce(half_low, half_high, F.lit(0.5))).alias("lo"), (x + F.coalesce(half_high, half_low, F.lit(0.5))).alias("hi"))


def _conservative(df: DataFrame, target: DataFrame, value: str, lat: str, lon: str, keys: Sequence[str]) -> DataFrame:
    overlaps = []
    for axis in (lat, lon):
        a = _edges(df, axis).select(F.col(axis).alias(f"__{axis}"), "lo", "hi")
        b = _edges(target, axis).select(axis, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        # Axes are dimensions of a grid, some thousand values at most.
        both = a.join(b, (F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")))
        low, high = F.greatest("lo", "lo2"), F.least("hi", "hi2")
        size = F.sin(F.radians(high)) - F.sin(F.radians(low)) if axis == lat else high - low
        overlaps.append(both.select(axis, f"__{axis}", size.alias(f"__w_{axis}")))
    cells = target.select(lat, lon).distinct().join(overlaps[0], lat).join(overlaps[1], lon)
    source = df.select(*keys, F.col(lat).alias(f"__{lat}"), F.col(lon).alias(f"__{lon}"), F.col(value).alias("__v")).filter("__v is not null")
    w = F.col(f"__w_{lat}") * F.col(f"__w_{lon}")
    return source.join(cells, [f"__{lat}", f"__{lon}"]).groupBy(*keys, lat, lon).agg(ratio(F.sum(F.col("__v") * w), F.sum(w)).alias(value))
