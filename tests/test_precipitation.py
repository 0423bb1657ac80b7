import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainloom.operators import precipitation as P

BASIC = [0, 2, 10, 20, 5, 0, 0, 1, 30, 4]


def series(spark, values, start=dt.datetime(2000, 1, 1), step=dt.timedelta(days=1), units=None):
    rows = [(start + k * step, None if v is None else float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, value double")
    return df.withMetadata("value", {"units": units}) if units else df


def one(df, name):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][name]


@pytest.mark.parametrize(("name", "want"), [("rx1day", 30), ("rx5day", 37), ("prcptot", 72), ("r10mm", 3), ("r20mm", 2), ("cwd", 4), ("cdd", 2), ("wet_day_count", 7), ("sdii", 72 / 7)])
def test_indices(spark, name, want):
    assert one(getattr(P, name)(series(spark, BASIC), min_valid_fraction=0, frequency="daily"), name) == pytest.approx(want)


def test_percentile_with_reference_and_units(spark):
    assert one(P.r95p(series(spark, BASIC), reference=9.0, min_valid_fraction=0), "r95p") == 60
    assert one(P.r99p(series(spark, BASIC), reference=9.0, min_valid_fraction=0), "r99p") == 60
    assert one(P.r95p_fraction(series(spark, BASIC), reference=9.0, min_valid_fraction=0), "r95p_fraction") == pytest.approx(100 * 60 / 72)
    assert one(P.rx1day(series(spark, BASIC, units="m"), min_valid_fraction=0), "rx1day") == 30000
    assert one(P.rx1day(series(spark, BASIC, units="mm/day"), min_valid_fraction=0), "rx1day") == pytest.approx(30)
    with pytest.raises(ValueError, match="Unsupported precipitation units"):
        P.rx1day(series(spark, BASIC, units="inches"), frequency="daily")


def test_hourly_rate_and_flux(spark):
    hourly = series(spark, [1.0] * 48, step=dt.timedelta(hours=1), units="mm/hr")
    assert [r.value for r in P.daily_amount(hourly).orderBy("time").collect()] == pytest.approx([24, 24])
    assert one(P.rx1day(hourly, min_valid_fraction=0), "rx1day") == pytest.approx(24)
    flux = P.normalize_precipitation(series(spark, [1.0] * 24, step=dt.timedelta(hours=1), units="kg m-2 s-1"))
    assert flux.schema["value"].metadata["units"] == "mm/hr"
    assert flux.agg(F.min("value"), F.max("value")).first() == (3600, 3600)


def test_boundaries(spark):
    df = series(spark, [0.999999, 1, 1.000001, 9.999999, 10, 20])
    out = P.annual_indices(df, ("wet_day_count", "prcptot", "r10mm", "r20mm"), min_valid_fraction=0).first()
    assert (out.wet_day_count, out.r10mm, out.r20mm) == (5, 2, 1) and out.prcptot == pytest.approx(42)


def test_missing_breaks_runs_and_years(spark):
    assert one(P.cwd(series(spark, [2, 2, None, 2]), min_valid_fraction=0, frequency="daily"), "cwd") == 2
    year = series(spark, [None] * 37 + [1.0] * 328, start=dt.datetime(2001, 1, 1))
    assert one(P.prcptot(year, frequency="daily"), "prcptot") is None
    assert one(P.prcptot(year, frequency="daily", min_valid_fraction=0.89), "prcptot") == 328


@pytest.mark.parametrize(("calendar", "days"), [("noleap", 365), ("360_day", 360)])
def test_calendars(spark, calendar, days):
    per = 30 if calendar == "360_day" else None
    parts = [(2001, k // 30 + 1, k % 30 + 1) for k in range(360)] if per else [((d := dt.date(2001, 1, 1) + dt.timedelta(days=k)).year, d.month, d.day) for k in range(365)]
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(days=k), *p, 1.0) for k, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, cal_year int, cal_month int, cal_day int, value double").withMetadata("time", {"calendar": calendar})
    assert one(P.prcptot(df, frequency="daily", min_valid_fraction=1.0), "prcptot") == days


def test_accumulation_resets(spark):
    rows = [(k, 0.0 + a, 0.0 + b) for k, (a, b) in enumerate([(0, 0), (1, 2), (0.2, 0.3), (1.2, 1.3)])]
    df = spark.createDataFrame(rows, "Time long, RAINC double, RAINNC double")
    assert [r.precipitation for r in P.wrf_precipitation_amount(df).orderBy("Time").collect()] == pytest.approx([0, 3, 0.5, 2])
    with pytest.raises(KeyError):
        P.wrf_total_precipitation(df.drop("RAINC"))


def test_irregular_raises_and_resample(spark):
    df = series(spark, [1, 2, 3], step=dt.timedelta(hours=7))
    with pytest.raises(ValueError):
        P.rx1day(df)
    assert one(P.resample_precipitation(series(spark, [None, None]), unit="MONTH"), "value") is None
    assert one(P.resample_precipitation(series(spark, [1, None, 4]), unit="MONTH", how="max"), "value") == 4
