"""Climatologies, anomalies, seasonal means and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import metadata
from .timeaxis import DAY, FREQUENCIES, SEASONS, calendar_name, days_in_month, infer_frequency, month_of, season_year, year_of


def _group(df: DataFrame, time: str, group: str):
    if group == "month":
        return month_of(df, time)
    if group == "dayofyear":
        return F.dayofyear(time)
    raise ValueError("group must be 'month' or 'dayofyear'")


def climatology(df: DataFrame, group: str = "month", *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, group, climatology): means over all years."""
    return df.groupBy(*keys, _group(df, time, group).alias(group)).agg(F.avg(value).alias("climatology"))


def anomaly(df: DataFrame, reference: DataFrame | None = None, group: str = "month", *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with group and anomaly: the value less its climatology (its own, or ``reference``'s)."""
    means = reference if reference is not None else climatology(df, group, value=value, time=time, keys=keys)
    out = df.withColumn(group, _group(df, time, group)).join(means, [*keys, group], "left")
    return out.withColumn("anomaly", F.col(value) - F.col("climatology")).drop("climatology")


def seasonal_mean(df: DataFrame, season: str, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """The mean over the months of a season, all years together."""
    if season.upper() not in SEASONS:
        raise ValueError("season must be one of DJF, MAM, JJA or SON")
    return df.filter(month_of(df, time).isin(*SEASONS[season.upper()])).groupBy(*keys).agg(F.avg(value).alias("seasonal_mean"))


def monsoon_total(df: DataFrame, start_month: int = 6, end_month: int = 9, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """The sum of each year over the months; 0 where all are missing."""
    if not 1 <= start_month <= end_month <= 12:
        raise ValueError("start_month and end_month must be months in order")
    rows = df.filter(month_of(df, time).between(start_month, end_month))
    return rows.groupBy(*keys, year_of(df, time).alias("year")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("monsoon_total"))


def is_precipitation(df: DataFrame, value: str = "value") -> bool:
    """Whether the metadata of the column speak of precipitation."""
    text = " ".join(str(v) for v in metadata(df, value).values()).lower()
    return any(token in text for token in ("precip", "rain", "prcp"))


def seasonal_series(df: DataFrame, season: str, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), aggregation: str = "auto", min_valid_fraction: float = 1.0, frequency: str | None = None) -> DataFrame:
    """Rows (keys, season_year, value): the sum or mean of each season, null if incomplete.

    Precipitation is summed and anything else averaged, unless ``aggregation`` says.  The samples
    to expect follow from the calendar and the frequency, which is inferred by a job unless given.
    """
    if aggregation == "auto":
        aggregation = "sum" if is_precipitation(df, value) else "mean"
    if aggregation not in ("sum", "mean"):
        raise ValueError("aggregation must be 'auto', 'sum' or 'mean'")
    months = SEASONS.get(season.upper())
    if months is None:
        raise ValueError("season must be one of DJF, MAM, JJA or SON")
    frequency = frequency or infer_frequency(df, time=time, keys=keys)
    if frequency == "irregular":
        raise ValueError("a seasonal series needs a regular time axis")
    out = season_year(df, time=time, season=season).filter(month_of(df, time).isin(*months))
    out = out.groupBy(*keys, "season_year").agg((F.sum(value) if aggregation == "sum" else F.avg(value)).alias("value"), F.count(value).alias("samples"))
    if frequency == "monthly":
        expected = F.lit(len(months))
    else:
        days = sum(days_in_month(F.col("season_year") - (1 if m == 12 else 0), F.lit(m), calendar_name(df, time)) for m in months)
        expected = days * F.lit(int(DAY / FREQUENCIES[frequency]))
    return out.select(*keys, "season_year", F.when(F.col("samples") >= expected * F.lit(float(min_valid_fraction)), F.col("value")).alias("value"))
