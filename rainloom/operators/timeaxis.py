"""Calendars, time steps, completeness and season years.

Tables may carry integer columns cal_year, cal_month and cal_day for calendars that DATE cannot
hold; they are used where present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import metadata, series

#: Calendar spellings, and seconds of the known frequencies.
CALENDARS = {
    "standard": "standard",
    "gregorian": "standard",
    "proleptic_gregorian": "proleptic_gregorian",
    "julian": "julian",
    "noleap": "noleap",
    "365_day": "noleap",
    "all_leap": "all_leap",
    "366_day": "all_leap",
    "360_day": "360_day",
}
FREQUENCIES = {"hourly": 3600.0, "3-hourly": 10800.0, "6-hourly": 21600.0, "daily": 86400.0, "monthly": 30.4375 * 86400.0}
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
DAY = 86400.0


def calendar_name(df: DataFrame, time: str = "time") -> str:
    return calendar(metadata(df, time).get("calendar", "standard"))


def calendar(name: str) -> str:
    return CALENDARS.get(str(name).lower(), str(name).lower())


def year_of(df: DataFrame, time: str = "time") -> Column:
    return F.col("cal_year") if "cal_year" in df.columns else F.year(time)


def month_of(df: DataFrame, time: str = "time") -> Column:
    return F.col("cal_month") if "cal_month" in df.columns else F.month(time)


def day_of(df: DataFrame, time: str = "time") -> Column:
    return F.col("cal_day") if "cal_day" in df.columns else F.dayofmonth(time)


def expected_days_in_year(year: Column, name: str = "standard") -> Column:
    """Days of the year in a CF calendar; an unknown calendar raises."""
    kind = calendar(name)
    fixed = {"360_day": 360, "noleap": 365, "all_leap": 366}
    if kind in fixed:
        return F.lit(fixed[kind])
    if kind not in ("standard", "proleptic_gregorian", "julian"):
        raise ValueError(f"unsupported CF calendar {name!r}")
    leap = year % 4 == 0
    if kind != "julian":
        leap = leap & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(leap, 366).otherwise(365)


def days_in_month(year: Column, month: Column, name: str = "standard") -> Column:
    kind = calendar(name)
    if kind == "360_day":
        return F.lit(30)
    leap = expected_days_in_year(year, name) == 366
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def expected_days(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows (year, expected_days) of the years present."""
    return df.select(year_of(df, time).alias("year")).distinct().withColumn("expected_days", expected_days_in_year(F.col("year"), calendar_name(df, time)).cast("long"))


def seconds_between(later: Column, earlier: Column) -> Column:
    later, earlier = later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def time_step_seconds(df: DataFrame, *, time: str = "time", keys: Sequence[str] = (), bounds: tuple[str, str] | None = None, name: str = "step_seconds") -> DataFrame:
    """``df`` with the step to each time: the width of its bounds, else from the time before it in
    the series, for the first from the second; a lone time has none."""
    if bounds:
        return df.withColumn(name, seconds_between(F.col(bounds[1]), F.col(bounds[0])))
    w = series(keys, time)
    back, ahead = seconds_between(F.col(time), F.lag(time).over(w)), seconds_between(F.lead(time).over(w), F.col(time))
    return df.withColumn(name, F.coalesce(back, ahead))


def forward_step_seconds(df: DataFrame, *, time: str = "time", keys: Sequence[str] = (), name: str = "step_seconds") -> DataFrame:
    """The step to the next time, for the last from the one before."""
    w = series(keys, time)
    return df.withColumn(name, F.coalesce(seconds_between(F.lead(time).over(w), F.col(time)), seconds_between(F.col(time), F.lag(time).over(w))))


def median_step(df: DataFrame, *, time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """One row (median_step, frequency): the median positive step over the distinct times, or of each series."""
    distinct = df.select(*keys, time).distinct()
    steps = time_step_seconds(distinct, time=time, keys=keys).filter("step_seconds > 0")
    return steps.groupBy(*keys).agg(F.median("step_seconds").alias("median_step")).withColumn("frequency", frequency_of(F.col("median_step")))


def frequency_of(step: Column, tolerance: float = 0.02) -> Column:
    out = None
    for name, seconds in FREQUENCIES.items():
        near = F.abs(step - seconds) / seconds <= tolerance
        out = F.when(near, name) if out is None else out.when(near, name)
    return out.otherwise("irregular")


def infer_frequency(df: DataFrame, *, time: str = "time", keys: Sequence[str] = ()) -> str:
    """hourly, 3-hourly, 6-hourly, daily, monthly or irregular; declared metadata saves the job.

    ``keys`` are the series: steps are taken within them.
    """
    declared = metadata(df, time).get("frequency")
    if declared:
        return declared
    steps = time_step_seconds(df.select(*keys, time).distinct(), time=time, keys=keys).filter("step_seconds > 0")
    step = steps.agg(F.median("step_seconds")).first()[0]
    if step is None:
        raise ValueError("at least two valid times or time bounds are required")
    return next((n for n, s in FREQUENCIES.items() if abs(step - s) / s <= 0.02), "irregular")


def year_complete_mask(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), min_valid_fraction: float = 0.9) -> DataFrame:
    """Rows (keys, year, valid_days, expected_days, complete)."""
    if not 0 <= min_valid_fraction <= 1:
        raise ValueError("min_valid_fraction must be between 0 and 1")
    out = df.groupBy(*keys, year_of(df, time).alias("year")).agg(F.count(value).alias("valid_days"))
    out = out.withColumn("expected_days", expected_days_in_year(F.col("year"), calendar_name(df, time)).cast("long"))
    return out.withColumn("complete", F.lit(True) if min_valid_fraction == 0 else F.col("valid_days") / F.col("expected_days") >= min_valid_fraction)


def season_year(df: DataFrame, *, time: str = "time", season: str = "DJF", name: str = "season_year") -> DataFrame:
    """``df`` with the year of the season; for DJF a December counts to the next."""
    if season.upper() not in SEASONS:
        raise ValueError("season must be one of DJF, MAM, JJA or SON")
    year = year_of(df, time)
    return df.withColumn(name, F.when(month_of(df, time) == 12, year + 1).otherwise(year) if season.upper() == "DJF" else year)


def drop_leap_day(df: DataFrame, time: str = "time") -> DataFrame:
    return df.filter(~((month_of(df, time) == 2) & (day_of(df, time) == 29)))


def validate_time(df: DataFrame, *, time: str = "time", keys: Sequence[str] = (), sequence: str | None = None) -> DataFrame:
    """``df`` itself; no times, duplicates in a series, or disorder by ``sequence`` raise."""
    times = df.select(*keys, time)
    row = times.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if not row[0]:
        raise ValueError("the time coordinate is empty")
    if row[1] > 1:
        raise ValueError("duplicate timestamps detected")
    if sequence is not None:
        step = F.col(time) < F.lag(time).over(series(keys, sequence))
        if not df.select(step.alias("back")).filter("back").isEmpty():
            raise ValueError("the time coordinate is not increasing")
    return df


def sort_and_validate_time(df: DataFrame, *, time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    return validate_time(df, time=time, keys=keys).orderBy(*keys, time)


def valid_fraction(df: DataFrame, *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, valid_fraction): the share of rows with a value."""
    return df.groupBy(*keys).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("valid_fraction"))


def annual_valid_fraction(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, year_of(df, time).alias("year")).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("valid_fraction"))


def require_completeness(df: DataFrame, min_fraction: float = 0.9, *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the values of a series null unless enough of them are valid."""
    if not 0 <= min_fraction <= 1:
        raise ValueError("min_fraction must be between 0 and 1")
    share = F.avg(F.col(value).isNotNull().cast("double")).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.when(share >= min_fraction, F.col(value)))
