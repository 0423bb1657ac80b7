"""Precipitation amounts and annual indices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import unit_text
from ..model import metadata, ratio, series, with_metadata
from .timeaxis import calendar_name, expected_days_in_year, forward_step_seconds, infer_frequency, time_step_seconds, year_of

#: Factors to mm, and to mm a second by (numerator, seconds).
AMOUNTS = {"mm": 1.0, "millimeter": 1.0, "millimetre": 1.0, "cm": 10.0, "m": 1000.0, "meter": 1000.0, "metre": 1000.0}
RATES = {
    1: ("mm/s", "mm s-1", "mm s^-1", "kg m-2 s-1", "kg/m2/s", "kg m-2 s^-1"),
    60: ("mm/min", "mm min-1", "kg m-2 min-1", "kg/m2/min"),
    3600: ("mm/hour", "mm/hr", "mm h-1", "mm hr-1", "kg m-2 h-1", "kg/m2/hour"),
    86400: ("mm/day", "mm day-1", "mm d-1", "kg m-2 day-1", "kg m-2 d-1", "kg/m2/day"),
}
RATE_SECONDS = {name: seconds for seconds, names in RATES.items() for name in names}
DENOMINATORS = {"hourly": "hr", "3-hourly": "3hr", "6-hourly": "6hr", "daily": "day"}
SAMPLES = {"hourly": 24, "3-hourly": 8, "6-hourly": 4}


def _units(df: DataFrame, value: str, units: str | None) -> str:
    return unit_text(units or metadata(df, value).get("units") or "mm")


def interval_amount_mm(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), units: str | None = None, bounds: tuple[str, str] | None = None) -> DataFrame:
    """Amounts in mm of each interval; a rate is multiplied by its step.

    Missing units are mm.  A step that is missing or not positive counts as the median step.
    """
    unit = _units(df, value, units)
    if unit in AMOUNTS:
        out = df.withColumn(value, F.col(value) * F.lit(AMOUNTS[unit]))
    elif unit in RATE_SECONDS:
        stepped = time_step_seconds(df, time=time, keys=keys, bounds=bounds, name="__step")
        median = stepped.filter("__step > 0").agg(F.median("__step")).first()[0]
        if median is None:
            raise ValueError("at least two valid times are required for a rate")
        step = F.when(F.col("__step") > 0, F.col("__step")).otherwise(F.lit(float(median)))
        out = stepped.withColumn(value, F.col(value) * step / F.lit(float(RATE_SECONDS[unit]))).drop("__step")
    else:
        raise ValueError(f"Unsupported precipitation units {unit!r}")
    return with_metadata(out, value, units="mm", quantity="precipitation_amount", source_units=unit)


def normalize_precipitation(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), units: str | None = None, frequency: str | None = None) -> DataFrame:
    """Interval amounts, labelled as mm/hr, mm/3hr, mm/6hr or mm/day where the axis is so regular."""
    amount = interval_amount_mm(df, value=value, time=time, keys=keys, units=units)
    frequency = frequency or _frequency(df, time, keys)
    if frequency not in DENOMINATORS:
        return with_metadata(amount, value, frequency=frequency, representation="period_amount")
    return with_metadata(amount, value, units=f"mm/{DENOMINATORS[frequency]}", quantity="precipitation_rate", frequency=frequency, representation="interval_rate")


def precipitation_to_mm(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), units: str | None = None) -> DataFrame:
    """Depths in mm: mm as it is, m times 1000, rates times the step to the next time; mm/day stays a rate."""
    unit = (units or metadata(df, value).get("units") or "").lower().replace(" ", "")
    if unit in ("mm", "mm/day", "mm/d"):
        return with_metadata(df, value, units="mm" if unit == "mm" else "mm/day")
    if unit == "m":
        return with_metadata(df.withColumn(value, F.col(value) * 1000.0), value, units="mm")
    factor = {"m/s": 1000.0, "msec-1": 1000.0, "ms-1": 1000.0, "kgm-2s-1": 1.0, "kgm^-2s^-1": 1.0, "kgm-2sec-1": 1.0}.get(unit)
    if factor is None:
        raise ValueError(f"Unsupported precipitation units: {unit!r}")
    stepped = forward_step_seconds(df, time=time, keys=keys, name="__step")
    step = F.when(F.col("__step") > 0, F.col("__step")).otherwise(F.raise_error(F.lit("time must be strictly increasing, with two times or more")).cast("double"))
    return with_metadata(stepped.withColumn(value, F.col(value) * step * factor).drop("__step"), value, units="mm")


def _frequency(df: DataFrame, time: str, keys: Sequence[str]) -> str:
    try:
        return infer_frequency(df, time=time, keys=keys)
    except ValueError:
        return "irregular"


def daily_amount(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), units: str | None = None, frequency: str | None = None) -> DataFrame:
    """Daily totals (keys, time, value) in mm of a sub-daily or irregular series; a day of missing values is 0.

    Daily and monthly series are as they are; a day without any row gives none.
    """
    amount = interval_amount_mm(df, value=value, time=time, keys=keys, units=units)
    frequency = frequency or _frequency(df, time, keys)
    if frequency in ("daily", "monthly"):
        return with_metadata(amount, value, frequency=frequency)
    days = amount.groupBy(*keys, F.to_date(time).alias(time)).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    return with_metadata(days, value, units="mm", quantity="precipitation_amount", frequency="daily")


def resample_precipitation(df: DataFrame, *, unit: str = "DAY", how: str = "sum", value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Sums (null if all are missing), maxima or means by calendar unit, or by a window like '3 hours'."""
    if how not in ("sum", "max", "mean"):
        raise ValueError("how must be 'sum', 'max' or 'mean'")
    by = F.window(time, unit).getField("start") if " " in unit else F.date_trunc(unit, time)
    return df.groupBy(*keys, by.alias(time)).agg({"sum": F.sum, "max": F.max, "mean": F.avg}[how](value).alias(value))


def accumulated_to_increment(df: DataFrame, *, value: str = "value", order: str = "time", keys: Sequence[str] = (), reset_tolerance: float = 0.0, name: str = "increment") -> DataFrame:
    """``df`` with the step of an accumulated value; a fall beyond the tolerance is a reset to a new start."""
    before = F.lag(value).over(series(keys, order))
    step = F.col(value) - before
    return df.withColumn(name, F.when(before.isNull() & (F.row_number().over(series(keys, order)) == 1), F.col(value)).when(step >= -reset_tolerance, step).when(step.isNotNull(), F.col(value)))


def wrf_total_precipitation(df: DataFrame, *, include_shallow: bool = False, convective: str = "RAINC", nonconvective: str = "RAINNC", shallow: str = "RAINSH", name: str = "total") -> DataFrame:
    parts = [convective, nonconvective, *([shallow] if include_shallow else [])]
    missing = [c for c in parts if c not in df.columns]
    if missing:
        raise KeyError(f"missing accumulation columns: {', '.join(missing)}")
    return df.withColumn(name, sum((F.col(c) for c in parts[1:]), F.col(parts[0])))


def wrf_precipitation_amount(df: DataFrame, *, order: str = "Time", keys: Sequence[str] = (), name: str = "precipitation", **parts: object) -> DataFrame:
    """Increments of the accumulated total; the first value stays, a fall is a restart."""
    return accumulated_to_increment(wrf_total_precipitation(df, name="__total", **parts), value="__total", order=order, keys=keys, name=name).drop("__total")


def validated_daily(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), units: str | None = None, frequency: str | None = None, min_daily_valid_fraction: float = 0.9) -> DataFrame:
    """``daily_amount`` with days of too few sub-daily values null; an irregular axis raises."""
    if not 0 <= min_daily_valid_fraction <= 1:
        raise ValueError("min_daily_valid_fraction must be between 0 and 1")
    frequency = frequency or _frequency(df, time, keys)
    if frequency == "irregular" and min_daily_valid_fraction:
        raise ValueError("indices need a regular daily or sub-daily time axis")
    if frequency not in SAMPLES or not min_daily_valid_fraction:
        return daily_amount(df, value=value, time=time, keys=keys, units=units, frequency=frequency)
    amount = interval_amount_mm(df, value=value, time=time, keys=keys, units=units)
    enough = F.count(value) / F.lit(SAMPLES[frequency]) >= min_daily_valid_fraction
    return with_metadata(amount.groupBy(*keys, F.to_date(time).alias(time)).agg(F.when(enough, F.sum(value)).alias(value)), value, units="mm", frequency="daily")


def threshold_mm(value: float, name: str = "threshold") -> float:
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be a finite non-negative value in mm")
    return float(value)


def wet_quantile(daily: DataFrame, q: float, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), start: str = "1961-01-01", end: str = "1990-12-31", wet_day_threshold: float = 1.0) -> DataFrame:
    """Rows (keys, threshold): the median-unbiased quantile of the wet days of the baseline.

    Order statistics k and k + 1 at (n + 1/3) q + 1/3, clamped, with linear interpolation.
    """
    if not 0 <= q <= 1:
        raise ValueError("the percentile must be between 0 and 1")
    wet = daily.filter(F.to_date(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col(value) >= wet_day_threshold))
    ordered = wet.withColumn("__k", F.row_number().over(series(keys, value))).withColumn("__n", F.count(value).over(Window.partitionBy(*keys)))
    place = F.least(F.greatest((F.col("__n") + F.lit(1 / 3)) * q + F.lit(1 / 3), F.lit(1.0)), F.col("__n").cast("double"))
    at = F.floor(place)
    part = place - at
    weight = F.when(F.col("__k") == at, 1 - part).when(F.col("__k") == at + 1, part)
    return ordered.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias("threshold"))


#: Index names and what each is an aggregate of.
INDICES = ("rx1day", "rx5day", "prcptot", "r10mm", "r20mm", "sdii", "wet_day_count", "cwd", "cdd", "r95p", "r99p", "r95p_fraction", "r99p_fraction")


def annual_indices(
    daily: DataFrame,
    names: Sequence[str] = INDICES,
    *,
    value: str = "value",
    time: str = "time",
    keys: Sequence[str] = (),
    min_valid_fraction: float = 0.9,
    wet_day_threshold: float = 1.0,
    dry_day_threshold: float = 1.0,
    heavy: float = 10.0,
    very_heavy: float = 20.0,
    reference: DataFrame | float | None = None,
    baseline: tuple[str, str] = ("1961-01-01", "1990-12-31"),
) -> DataFrame:
    """Rows (keys, year, names...) of a daily series in mm, all in one pass; incomplete years are null.

    ``reference``: the threshold of r95p and r99p, as a number or rows (keys, threshold), instead
    of the quantile of the baseline.  Series are shuffled once: windows and aggregates share the keys.
    """
    wet, dry = threshold_mm(wet_day_threshold, "wet_day_threshold"), threshold_mm(dry_day_threshold, "dry_day_threshold")
    heavy, very_heavy = threshold_mm(heavy), threshold_mm(very_heavy)
    unknown = set(names) - set(INDICES)
    if unknown:
        raise ValueError(f"unknown indices: {', '.join(sorted(unknown))}")
    x = F.col(value)
    rows = daily.select(*keys, time, x.cast("double").alias(value), year_of(daily, time).alias("year"))
    aggregates: dict[str, Column] = {}
    zero = F.lit(0.0)
    total = F.coalesce(F.sum(F.when(x >= wet, x)), zero)
    days = F.count(F.when(x >= wet, x))
    simple = {
        "rx1day": F.max(value),
        "prcptot": total,
        "r10mm": F.count(F.when(x >= heavy, x)),
        "r20mm": F.count(F.when(x >= very_heavy, x)),
        "wet_day_count": days,
        "sdii": ratio(F.sum(F.when(x >= wet, x)), days),
    }
    aggregates |= {n: c for n, c in simple.items() if n in names}
    if "rx5day" in names:
        five = series(keys, time).rowsBetween(-4, 0)
        rows = rows.withColumn("__five", F.when(F.count(value).over(five) == 5, F.sum(value).over(five)))
        aggregates["rx5day"] = F.max("__five")
    for name, holds in (("cwd", x >= wet), ("cdd", x < dry)):
        if name in names:
            year = Window.partitionBy(*keys, "year").orderBy(time)
            # The number of breaks so far is the name of a run; its length is counted along it.
            rows = rows.withColumn("__in", F.coalesce(holds, F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(year))
            along = Window.partitionBy(*keys, "year", "__run").orderBy(time)
            rows = rows.withColumn(f"__{name}", F.sum(F.col("__in").cast("int")).over(along)).drop("__in", "__run")
            aggregates[name] = F.coalesce(F.max(f"__{name}"), F.lit(0)).cast("long")
    for name, q in (("r95p", 0.95), ("r99p", 0.99)):
        if {name, f"{name}_fraction"} & set(names):
            if reference is None:
                limit = wet_quantile(daily, q, value=value, time=time, keys=keys, start=baseline[0], end=baseline[1], wet_day_threshold=wet)
            else:
                limit = reference
            if isinstance(limit, DataFrame):
                limit = limit.select(*keys, F.col("threshold").alias(f"__{name}"))
                rows = rows.join(limit, list(keys), "left") if keys else rows.crossJoin(F.broadcast(limit))
            else:
                rows = rows.withColumn(f"__{name}", F.lit(float(limit)))
            above = F.coalesce(F.sum(F.when(x > F.col(f"__{name}"), x)), zero)
            aggregates |= {n: c for n, c in {name: above, f"{name}_fraction": 100 * ratio(above, total)}.items() if n in names}
    out = rows.groupBy(*keys, "year").agg(F.count(value).alias("__valid"), *[aggregates[n].alias(n) for n in names])
    complete = F.lit(True) if not min_valid_fraction else F.col("__valid") / expected_days_in_year(F.col("year"), calendar_name(daily, time)) >= min_valid_fraction
    return out.select(*keys, "year", *[F.when(complete, F.col(n)).alias(n) for n in names])


def _index(name: str):
    def one(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), units: str | None = None, frequency: str | None = None, min_daily_valid_fraction: float = 0.9, **options: object) -> DataFrame:
        daily = validated_daily(df, value=value, time=time, keys=keys, units=units, frequency=frequency, min_daily_valid_fraction=min_daily_valid_fraction)
        return annual_indices(daily, (name,), value=value, time=time, keys=keys, **options)

    one.__name__ = one.__qualname__ = name
    one.__doc__ = f"Rows (keys, year, {name}) of a precipitation series; see ``annual_indices`` for the options."
    return one


rx1day, rx5day, prcptot, r10mm, r20mm, sdii, wet_day_count, cwd, cdd, r95p, r99p, r95p_fraction, r99p_fraction = map(_index, INDICES)
