"""The registered queries over ``views`` and the SQL that each is held against.

Measures are rounded to six places on both sides; SQL is left out where a kernel has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import scalars, units
from ..operators import climatology as C
from ..operators import drought, extremes, learning, metrics, spatial, tagging, timeaxis, trends
from ..operators import precipitation as P
from ..operators import verification as V
from ..sources import normalize
from . import views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WET, HEAVY, VERY_HEAVY = 250.0, 300.0, 400.0
BASE = ("1995-01-01", "1998-12-31")
THRESHOLD = 300.0
LEVELS = (400.0, 450.0, 500.0)


def register(plain: str, doubles: str = "", sql: str | None = None, on: str = "", name: str | None = None):
    """Register a query with columns ``plain`` as they are and ``doubles`` rounded."""

    def take(f):
        title = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*plain.split(), *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in doubles.split()])

        run.__name__ = title
        QUERIES[title] = run
        if sql:
            inner = with_views(sql, *on.split()) if on else sql
            SQL[title] = f"SELECT {', '.join([*plain.split(), *(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in doubles.split())])} FROM ({inner})"
        return f

    return take


DAYS = "CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 366 ELSE 365 END"


def _annual(name: str, expression: str, integer: bool = False, before: str = "d AS (SELECT *, year(time) AS year FROM daily)") -> None:
    options = {"wet_day_threshold": WET, "dry_day_threshold": WET, "heavy": HEAVY, "very_heavy": VERY_HEAVY, "baseline": BASE}
    sql = f"+{before} SELECT series, CAST(year AS BIGINT) AS year, CASE WHEN count(value) / CAST({DAYS} AS DOUBLE) >= 0.9 THEN {expression} END AS {name} FROM d GROUP BY series, year"

    @register("series year" + f" {name}" * integer, name * (not integer), sql, "daily", name)
    def one(spark, d):
        out = getattr(P, name)(views.daily(spark, d), keys=["series"], **options)
        return out.withColumn("year", F.col("year").cast("long"))


_annual("rx1day", "max(value)")
_annual("prcptot", f"coalesce(sum(value) FILTER (WHERE value >= {WET}), 0)")
_annual("r10mm", f"count(*) FILTER (WHERE value >= {HEAVY})", True)
_annual("r20mm", f"count(*) FILTER (WHERE value >= {VERY_HEAVY})", True)
_annual("wet_day_count", f"count(*) FILTER (WHERE value >= {WET})", True)
_annual("sdii", f"sum(value) FILTER (WHERE value >= {WET}) / nullif(count(*) FILTER (WHERE value >= {WET}), 0)")
_annual("rx5day", "max(five)", before="d AS (SELECT *, year(time) AS year, CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END AS five FROM daily WINDOW w AS (PARTITION BY series ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
for _name, _holds in (("cwd", f"value >= {WET}"), ("cdd", f"value < {WET}")):
    _annual(
        _name,
        "CAST(coalesce(max(run), 0) AS BIGINT)",
        True,
        f"a AS (SELECT *, year(time) AS year, row_number() OVER (PARTITION BY series, year(time) ORDER BY time) AS k FROM daily), b AS (SELECT *, k - row_number() OVER (PARTITION BY series, year ORDER BY time) AS island FROM a WHERE {_holds}), c AS (SELECT series, year, island, count(*) AS run FROM b GROUP BY ALL), m AS (SELECT series, year, max(run) AS run FROM c GROUP BY ALL), d AS (SELECT a.*, m.run FROM a LEFT JOIN m ON m.series = a.series AND m.year = a.year)",
    )


def _quantile_view(q: float) -> str:
    return (
        f"w AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) AS k, count(*) OVER (PARTITION BY series) AS n FROM daily WHERE value >= {WET} AND time BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}'), "
        f"h AS (SELECT *, least(greatest((n + 1.0::DOUBLE / 3) * {q}::DOUBLE + 1.0::DOUBLE / 3, 1), n) AS h FROM w), "
        "t AS (SELECT series, sum(value * CASE WHEN k = floor(h) THEN 1 - (h - floor(h)) WHEN k = floor(h) + 1 THEN h - floor(h) ELSE 0 END) AS threshold FROM h GROUP BY series), "
        "d AS (SELECT daily.*, year(time) AS year, threshold FROM daily LEFT JOIN t ON t.series = daily.series)"
    )


for _name, _q in (("r95p", 0.95), ("r99p", 0.99)):
    _annual(_name, "coalesce(sum(value) FILTER (WHERE value > threshold), 0)", before=_quantile_view(_q))
    _annual(f"{_name}_fraction", f"100 * coalesce(sum(value) FILTER (WHERE value > threshold), 0) / nullif(coalesce(sum(value) FILTER (WHERE value >= {WET}), 0), 0)", before=_quantile_view(_q))

# --- completeness and climatology --------------------------------------------------------------


@register("series year valid_days expected_days complete", "", f"SELECT series, CAST(year AS BIGINT) AS year, count(value) AS valid_days, CAST({DAYS} AS BIGINT) AS expected_days, count(value) / CAST({DAYS} AS DOUBLE) >= 0.1::DOUBLE AS complete FROM (SELECT *, year(time) AS year FROM sparse) GROUP BY series, year", "sparse")
def year_complete_mask(spark, d):
    return timeaxis.year_complete_mask(views.daily(spark, d, "l_suppkey"), keys=["series"], min_valid_fraction=0.1).withColumn("year", F.col("year").cast("long"))


@register("year expected_days", "", f"SELECT CAST(year AS BIGINT) AS year, CAST({DAYS} AS BIGINT) AS expected_days FROM (SELECT DISTINCT year(time) AS year FROM daily)", "daily")
def expected_days(spark, d):
    return timeaxis.expected_days(views.daily(spark, d)).withColumn("year", F.col("year").cast("long"))


def _gappy(spark, d):
    """Small days count as missing."""
    return views.daily(spark, d, "l_suppkey").withColumn("value", F.when(F.col("value") >= 20, F.col("value")))


GAPPY = "g AS (SELECT series, time, CASE WHEN value >= 20 THEN value END AS value FROM sparse)"


@register("series", "valid_fraction", f"+{GAPPY} SELECT series, count(value) / CAST(count(*) AS DOUBLE) AS valid_fraction FROM g GROUP BY series", "sparse")
def valid_fraction(spark, d):
    return timeaxis.valid_fraction(_gappy(spark, d), keys=["series"])


@register("series year", "valid_fraction", f"+{GAPPY} SELECT series, CAST(year(time) AS BIGINT) AS year, count(value) / CAST(count(*) AS DOUBLE) AS valid_fraction FROM g GROUP BY ALL", "sparse")
def annual_valid_fraction(spark, d):
    return timeaxis.annual_valid_fraction(_gappy(spark, d), keys=["series"]).withColumn("year", F.col("year").cast("long"))


@register("series time", "value", f"+{GAPPY} SELECT series, time, CASE WHEN count(value) OVER w / CAST(count(*) OVER w AS DOUBLE) >= 0.65::DOUBLE THEN value END AS value FROM g WINDOW w AS (PARTITION BY series)", "sparse")
def require_completeness(spark, d):
    return timeaxis.require_completeness(_gappy(spark, d), 0.65, keys=["series"])


for _group in ("month", "dayofyear"):
    _part = f"CAST({_group}(time) AS BIGINT)"

    @register(f"series {_group}", "climatology", f"SELECT series, {_part} AS {_group}, avg(value) AS climatology FROM daily GROUP BY ALL", "daily", f"climatology_{_group}")
    def _climatology(spark, d, group=_group):
        return C.climatology(views.daily(spark, d), group, keys=["series"]).withColumn(group, F.col(group).cast("long"))

    @register("series time", "anomaly", f"SELECT series, time, value - avg(value) OVER (PARTITION BY series, {_group}(time)) AS anomaly FROM daily", "daily", f"anomaly_{_group}")
    def _anomaly(spark, d, group=_group):
        return C.anomaly(views.daily(spark, d), group=group, keys=["series"])


@register("series", "seasonal_mean", "SELECT series, avg(value) AS seasonal_mean FROM daily WHERE month(time) IN (12, 1, 2) GROUP BY series", "daily")
def seasonal_mean_djf(spark, d):
    return C.seasonal_mean(views.daily(spark, d), "DJF", keys=["series"])


@register("series year", "monsoon_total", "SELECT series, CAST(year(time) AS BIGINT) AS year, coalesce(sum(value), 0) AS monsoon_total FROM daily WHERE month(time) BETWEEN 6 AND 9 GROUP BY ALL", "daily")
def monsoon_total(spark, d):
    return C.monsoon_total(views.daily(spark, d), keys=["series"]).withColumn("year", F.col("year").cast("long"))


@register("series season_year n", "total", "SELECT series, CAST(year(time) + CASE WHEN month(time) = 12 THEN 1 ELSE 0 END AS BIGINT) AS season_year, count(*) AS n, sum(value) AS total FROM daily WHERE month(time) IN (12, 1, 2) GROUP BY ALL", "daily")
def season_year_djf(spark, d):
    rows = timeaxis.season_year(views.daily(spark, d)).filter(F.month("time").isin(12, 1, 2))
    return rows.groupBy("series", F.col("season_year").cast("long").alias("season_year")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


for _season, _months, _days in (("jja", "6, 7, 8", "92"), ("djf", "12, 1, 2", "90 + CASE WHEN sy % 4 = 0 AND (sy % 100 <> 0 OR sy % 400 = 0) THEN 1 ELSE 0 END")):

    @register("series season_year", "value", f"+s AS (SELECT series, value, CAST(year(time) + CASE WHEN month(time) = 12 THEN 1 ELSE 0 END AS BIGINT) AS sy FROM daily WHERE month(time) IN ({_months})) SELECT series, sy AS season_year, CASE WHEN count(value) >= {_days} THEN sum(value) END AS value FROM s GROUP BY series, sy", "daily", f"seasonal_series_{_season}")
    def _seasonal(spark, d, season=_season):
        return C.seasonal_series(views.daily(spark, d), season, keys=["series"]).withColumn("season_year", F.col("season_year").cast("long"))


@register("series time", "value", "SELECT series, time, value FROM daily WHERE NOT (month(time) = 2 AND day(time) = 29)", "daily")
def drop_leap_day(spark, d):
    return timeaxis.drop_leap_day(views.daily(spark, d))


# --- time steps, amounts, accumulation ---------------------------------------------------------

STEPS = "s AS (SELECT *, epoch(time - lag(time) OVER w) AS back, epoch(lead(time) OVER w - time) AS ahead FROM hourly WINDOW w AS (PARTITION BY series ORDER BY time)), x AS (SELECT *, coalesce(back, ahead) AS step_seconds FROM s)"


@register("series time", "step_seconds", f"+{STEPS} SELECT series, time, step_seconds FROM x", "hourly")
def time_step_seconds(spark, d):
    return timeaxis.time_step_seconds(views.hourly(spark, d), keys=["series"])


@register("series frequency", "median_step", f"+{STEPS}, m AS (SELECT series, median(step_seconds) AS median_step FROM x WHERE step_seconds > 0 GROUP BY series) SELECT series, CASE WHEN abs(median_step - 3600) / 3600 <= 0.02 THEN 'hourly' WHEN abs(median_step - 10800) / 10800 <= 0.02 THEN '3-hourly' WHEN abs(median_step - 21600) / 21600 <= 0.02 THEN '6-hourly' WHEN abs(median_step - 86400) / 86400 <= 0.02 THEN 'daily' WHEN abs(median_step - 2629800) / 2629800 <= 0.02 THEN 'monthly' ELSE 'irregular' END AS frequency, median_step FROM m", "hourly")
def infer_frequency(spark, d):
    return timeaxis.median_step(views.hourly(spark, d), keys=["series"])


@register("series time", "value", "SELECT series, CAST(time AS DATE) AS time, coalesce(sum(value), 0) AS value FROM hourly GROUP BY ALL", "hourly")
def daily_amount(spark, d):
    return P.daily_amount(views.hourly(spark, d), keys=["series"], frequency="hourly")


@register("series time", "value", "SELECT series, CAST(time AS DATE) AS time, CASE WHEN count(value) / 24.0 >= 0.9 THEN sum(value) END AS value FROM hourly GROUP BY ALL", "hourly")
def validated_daily(spark, d):
    return P.validated_daily(views.hourly(spark, d), keys=["series"], frequency="hourly")


@register("series time", "value", f"+{STEPS} SELECT series, time, value * CASE WHEN step_seconds > 0 THEN step_seconds ELSE (SELECT median(step_seconds) FROM x WHERE step_seconds > 0) END / 3600 AS value FROM x", "hourly")
def interval_amount_mm(spark, d):
    return P.interval_amount_mm(views.hourly(spark, d), keys=["series"], units="mm/hr")


@register("series time", "value", f"+{STEPS} SELECT series, time, value * coalesce(ahead, back) AS value FROM x", "hourly")
def precipitation_rate_to_mm(spark, d):
    return P.precipitation_to_mm(views.hourly(spark, d), keys=["series"], units="kg m-2 s-1")


for _how, _sql in (("sum", "sum(value)"), ("max", "max(value)"), ("mean", "avg(value)")):

    @register("series time", "value", f"SELECT series, date_trunc('week', time) AS time, {_sql} AS value FROM hourly GROUP BY ALL", "hourly", f"resample_{_how}")
    def _resample(spark, d, how=_how):
        return P.resample_precipitation(views.hourly(spark, d), unit="WEEK", how=how, keys=["series"]).withColumn("time", F.col("time").cast("timestamp_ntz"))


#: A sum that starts again with every hundredth event of a type.
ACCUMULATED = "a AS (SELECT event_type AS series, event_id, value, CAST(value * 1000 AS BIGINT) AS v, event_id // 100 AS part FROM events), c AS (SELECT series, event_id, part, sum(v) OVER (PARTITION BY series, part ORDER BY event_id) AS total FROM a), s AS (SELECT *, total - lag(total) OVER (PARTITION BY series ORDER BY event_id) AS step FROM c)"


def _accumulated(spark, d):
    from pyspark.sql import Window

    rows = views.table(spark, d, "events").select(F.col("event_type").alias("series"), "event_id", F.round(F.col("value") * 1000).cast("long").alias("v"), F.floor(F.col("event_id") / 100).alias("part"))
    return rows.withColumn("RAINNC", F.sum("v").over(Window.partitionBy("series", "part").orderBy("event_id"))).withColumn("RAINC", F.lit(0).cast("long"))


@register("series event_id increment", "", f"WITH {ACCUMULATED} SELECT series, event_id, CAST(CASE WHEN step >= 0 THEN step ELSE total END AS BIGINT) AS increment FROM s")
def accumulated_to_increment(spark, d):
    return P.accumulated_to_increment(_accumulated(spark, d), value="RAINNC", order="event_id", keys=["series"])


@register("series event_id precipitation", "", f"WITH {ACCUMULATED} SELECT series, event_id, CAST(CASE WHEN step >= 0 THEN step ELSE total END AS BIGINT) AS precipitation FROM s")
def wrf_precipitation_amount(spark, d):
    return P.wrf_precipitation_amount(_accumulated(spark, d), order="event_id", keys=["series"])


@register("series event_id total", "", f"WITH {ACCUMULATED} SELECT series, event_id, CAST(total AS BIGINT) AS total FROM s")
def wrf_total_precipitation(spark, d):
    return P.wrf_total_precipitation(_accumulated(spark, d))


# --- units, thermodynamics, space --------------------------------------------------------------


def _state(spark, d):
    """Orders as states: temperature 250-310 K, pressure 900-1000 hPa, humidity as a fraction."""
    o = views.table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), (F.lit(250.0) + key % 60).alias("t"), (F.lit(90000.0) + key % 100 * 100).alias("p"), ((key % 97) / F.lit(96.0)).alias("rh"))


STATE = "st AS (SELECT o_orderkey AS id, 250.0::DOUBLE + o_orderkey % 60 AS t, 90000.0::DOUBLE + o_orderkey % 100 * 100 AS p, (o_orderkey % 97) / 96.0::DOUBLE AS rh FROM orders), e AS (SELECT *, 611.2::DOUBLE * exp(17.67::DOUBLE * (t - 273.15::DOUBLE) / (t - 273.15::DOUBLE + 243.5::DOUBLE)) AS es FROM st), q AS (SELECT *, 0.622::DOUBLE * rh * es / (p - 0.378::DOUBLE * rh * es) AS q FROM e)"


@register("id", "es", f"WITH {STATE} SELECT id, es FROM e")
def saturation_vapor_pressure(spark, d):
    return _state(spark, d).withColumn("es", scalars.saturation_vapor_pressure(F.col("t")))


@register("id", "q", f"WITH {STATE} SELECT id, q FROM q")
def specific_humidity_from_rh(spark, d):
    return _state(spark, d).withColumn("q", scalars.specific_humidity_from_rh(F.col("t"), F.col("p"), F.col("rh")))


@register("id", "theta", f"WITH {STATE} SELECT id, t * pow(100000.0::DOUBLE / p, 0.2854::DOUBLE) AS theta FROM st")
def potential_temperature(spark, d):
    return _state(spark, d).withColumn("theta", scalars.potential_temperature(F.col("t"), F.col("p")))


@register("id", "theta_e", f"WITH {STATE}, r AS (SELECT *, q / (1 - q) AS r FROM q WHERE q > 0), v AS (SELECT *, r * p / (0.622::DOUBLE + r) / 100 AS eh FROM r), l AS (SELECT *, 1 / (1 / (t - 55) - ln(eh / 6.112::DOUBLE) / 2840) + 55 AS tl FROM v) SELECT id, t * pow(100000.0::DOUBLE / p, 0.2854::DOUBLE * (1 - 0.28::DOUBLE * r)) * exp((3036 / tl - 1.78::DOUBLE) * r * (1 + 0.448::DOUBLE * r)) AS theta_e FROM l")
def equivalent_potential_temperature(spark, d):
    s = _state(spark, d).withColumn("q", scalars.specific_humidity_from_rh(F.col("t"), F.col("p"), F.col("rh"))).filter("q > 0")
    return s.withColumn("theta_e", scalars.equivalent_potential_temperature(F.col("t"), F.col("p"), F.col("q")))


_CONVERSIONS = (("temperature", "degC", "K", "c_acctbal + 273.15::DOUBLE"), ("pressure", "hPa", "Pa", "c_acctbal * 100"), ("humidity", "%", "1", "c_acctbal / 100"), ("amount", "cm", "mm", "c_acctbal * 10"), ("flux", "mm/day", "kg m-2 s-1", "c_acctbal / 86400"), ("wind", "km/h", "m s-1", "c_acctbal * (1000.0::DOUBLE / 3600)"))
for _title, _from, _to, _sql in _CONVERSIONS:

    @register("c_custkey", "x", f"SELECT c_custkey, {_sql} AS x FROM customer", name=f"convert_units_{_title}")
    def _convert(spark, d, source=_from, target=_to):
        return units.convert_units(views.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x")), "x", target, source_units=source)


def _product(spark, d):
    """Customers as cells of a product with spellings and units of its own."""
    cells = views.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_custkey") % 360).cast("double").alias("LON"), F.col("c_acctbal").alias("t2m"), F.abs("c_acctbal").alias("tp"))
    return cells.withMetadata("t2m", {"units": "degC"}).withMetadata("tp", {"units": "m"})


_CELLS = "SELECT c_custkey AS cell, CAST(c_nationkey AS DOUBLE) AS latitude, CAST(c_custkey % 360 AS DOUBLE) AS longitude"


@register("cell", "latitude longitude", f"{_CELLS} FROM customer")
def normalize_coords(spark, d):
    return normalize.normalize_coords(_product(spark, d), dataset="era5", strict=True)


@register("cell", "temperature precipitation", "SELECT c_custkey AS cell, c_acctbal AS temperature, abs(c_acctbal) AS precipitation FROM customer")
def standardize_variables(spark, d):
    return normalize.standardize_variables(_product(spark, d), dataset="era5")


@register("cell", "latitude longitude temperature precipitation", f"{_CELLS}, c_acctbal + 273.15::DOUBLE AS temperature, abs(c_acctbal) * 1000 AS precipitation FROM customer")
def normalize_dataset(spark, d):
    return normalize.normalize_dataset(_product(spark, d), dataset="era5")


@register("station_id time", "latitude precipitation", "SELECT s_suppkey AS station_id, TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(s_suppkey % 365 AS INTEGER)) AS time, CAST(s_nationkey AS DOUBLE) AS latitude, s_acctbal AS precipitation FROM supplier")
def normalize_stations(spark, d):
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")), "yyyy-MM-dd")
    return normalize.normalize_stations(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("stn"), day.alias("Date"), F.col("s_nationkey").cast("double").alias("LAT"), F.col("s_acctbal").alias("rainfall")))


@register("c_custkey", "x", "SELECT c_custkey, c_acctbal * 100 AS x FROM customer")
def to_si(spark, d):
    return units.to_si(views.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x")), "x", "surface_pressure", source_units="hPa")


@register("cell", "temperature surface_pressure", "SELECT c_custkey AS cell, c_acctbal + 273.15::DOUBLE AS temperature, c_acctbal * 100 AS surface_pressure FROM customer")
def normalize_units(spark, d):
    df = views.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("temperature"), F.col("c_acctbal").alias("surface_pressure"))
    return units.normalize_units(df.withMetadata("temperature", {"units": "degC"}).withMetadata("surface_pressure", {"units": "hPa"}))


@register("name size", "", "SELECT 'latitude' AS name, count(DISTINCT c_nationkey) AS size FROM customer UNION ALL SELECT 'longitude', count(DISTINCT c_custkey % 360) FROM customer")
def describe_dataset(spark, d):
    dims = model.describe_dataset(normalize.normalize_coords(_product(spark, d), dataset="era5"))["dims"]
    return spark.createDataFrame(sorted(dims.items()), "name string, size long")


@register("c_custkey", "longitude", "SELECT c_custkey, CASE WHEN (CAST(c_custkey * 7 AS DOUBLE) + 180) % 360 - 180 = -180 AND c_custkey > 0 THEN 180 ELSE (CAST(c_custkey * 7 AS DOUBLE) + 180) % 360 - 180 END AS longitude FROM customer")
def normalize_longitude(spark, d):
    return spatial.normalize_longitude(views.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7).cast("double").alias("longitude")))


@register("", "latitude weight", "+l AS (SELECT DISTINCT latitude, cos(radians(latitude)) AS w FROM grid) SELECT latitude, w / (SELECT avg(w) FROM l) AS weight FROM l", "grid")
def cosine_latitude_weights(spark, d):
    return spatial.cosine_latitude_weights(views.grid(spark, d))


@register("time", "value", "SELECT time, sum(observation * cos(radians(latitude))) / nullif(sum(CASE WHEN observation IS NOT NULL THEN cos(radians(latitude)) END), 0) AS value FROM grid GROUP BY time", "grid")
def area_weighted_mean(spark, d):
    return spatial.area_weighted_mean(views.grid(spark, d), value="observation", keys=["time"])


@register("time", "value", "SELECT time, sum(observation * (1 + lat_idx)) / sum(1 + lat_idx) AS value FROM grid GROUP BY time", "grid")
def regional_mean(spark, d):
    g = views.grid(spark, d)
    weights = g.select("latitude", "longitude", (F.col("lat_idx") + 1.0).alias("weight")).distinct()
    return spatial.regional_mean(g, value="observation", weights=weights)


TARGET = "tg AS (SELECT 11.0::DOUBLE + 3 * i AS latitude, 72.0::DOUBLE + 4 * j AS longitude FROM range(8) a(i), range(6) b(j))"


def _target(spark):
    return spark.createDataFrame([(11.0 + 3 * i, 72.0 + 4 * j) for i in range(8) for j in range(6)], "latitude double, longitude double")


def _axis(name: str) -> str:
    lo, n = (10, 5) if name == "latitude" else (70, 5)
    return f"(SELECT t AS {name}, {lo} + 5 * i AS src, CASE WHEN {lo} + 5 * i <= t THEN 1 - (t - ({lo} + 5 * i)) / 5 ELSE 1 - (({lo} + 5 * i) - t) / 5 END AS w FROM (SELECT DISTINCT {name} AS t FROM tg), range({n}) r(i) WHERE abs({lo} + 5 * i - t) < 5 AND t BETWEEN {lo} AND {lo} + 20)"


_REGRID = "SELECT time, a.latitude, o.longitude, {value} AS value FROM grid g JOIN {lat} a ON a.src = g.latitude JOIN {lon} o ON o.src = g.longitude GROUP BY ALL"


@register("time latitude longitude", "value", f"+{TARGET} {_REGRID.format(value='CASE WHEN sum(a.w * o.w) > 1 - 1e-9 THEN sum(observation * a.w * o.w) END', lat=_axis('latitude'), lon=_axis('longitude'))}", "grid")
def regrid_linear(spark, d):
    return spatial.regrid(views.grid(spark, d), _target(spark), value="observation").withColumnRenamed("observation", "value")


@register("time latitude longitude", "value", "+" + TARGET + ", nl AS (SELECT t AS latitude, arg_min(src, (abs(src - t), src)) AS src FROM (SELECT DISTINCT latitude AS t FROM tg WHERE latitude BETWEEN 10 AND 30), (SELECT 10.0::DOUBLE + 5 * i AS src FROM range(5) r(i)) GROUP BY t), no AS (SELECT t AS longitude, arg_min(src, (abs(src - t), src)) AS src FROM (SELECT DISTINCT longitude AS t FROM tg WHERE longitude BETWEEN 70 AND 90), (SELECT 70.0::DOUBLE + 5 * i AS src FROM range(5) r(i)) GROUP BY t) SELECT time, nl.latitude, no.longitude, observation AS value FROM grid g JOIN nl ON nl.src = g.latitude JOIN no ON no.src = g.longitude", "grid")
def regrid_nearest(spark, d):
    return spatial.regrid(views.grid(spark, d), _target(spark), method="nearest", value="observation").withColumnRenamed("observation", "value")


@register("time latitude longitude", "observation")
def regrid_conservative(spark, d):
    return spatial.regrid(views.grid(spark, d), _target(spark), method="conservative", value="observation")


# --- scores ------------------------------------------------------------------------------------

COUNTS = f"c AS (SELECT series, count(*) FILTER (WHERE a AND b) AS h, count(*) FILTER (WHERE a AND NOT b) AS m, count(*) FILTER (WHERE NOT a AND b) AS f, count(*) FILTER (WHERE NOT a AND NOT b) AS n FROM (SELECT series, coalesce(observation >= {THRESHOLD}, false) AS a, coalesce(prediction >= {THRESHOLD}, false) AS b FROM pairs) GROUP BY series), s AS (SELECT *, CAST(h + m + f + n AS DOUBLE) AS t, h / CAST(nullif(h + m, 0) AS DOUBLE) AS pod, h / CAST(nullif(h + f, 0) AS DOUBLE) AS sr FROM c), e AS (SELECT *, ((h + m) * (h + f) + (n + m) * (n + f)) / t AS ex, (h + m) * (h + f) / t AS hr FROM s)"
_SCORES = {
    "bias": ("bias", "SELECT series, avg(prediction - observation) AS bias FROM pairs GROUP BY series"),
    "mae": ("mae", "SELECT series, avg(abs(prediction - observation)) AS mae FROM pairs GROUP BY series"),
    "rmse": ("rmse", "SELECT series, sqrt(avg(pow(prediction - observation, 2))) AS rmse FROM pairs GROUP BY series"),
    "correlation": ("correlation", "SELECT series, covar_pop(observation, prediction) / nullif(stddev_pop(observation) * stddev_pop(prediction), 0) AS correlation FROM pairs GROUP BY series"),
    "bias_ratio": ("bias_ratio", "SELECT series, sum(prediction) / nullif(sum(observation), 0) AS bias_ratio FROM pairs GROUP BY series"),
    "pod": ("pod", f"+{COUNTS} SELECT series, pod FROM e"),
    "far": ("far", f"+{COUNTS} SELECT series, f / CAST(nullif(h + f, 0) AS DOUBLE) AS far FROM e"),
    "f1_score": ("f1", f"+{COUNTS} SELECT series, 2 * pod * sr / nullif(pod + sr, 0) AS f1 FROM e"),
    "heidke_skill_score": ("heidke_skill_score", f"+{COUNTS} SELECT series, (h + n - ex) / nullif(t - ex, 0) AS heidke_skill_score FROM e"),
    "threat_score": ("threat_score", f"+{COUNTS} SELECT series, h / CAST(nullif(h + m + f, 0) AS DOUBLE) AS threat_score FROM e"),
    "equitable_threat_score": ("equitable_threat_score", f"+{COUNTS} SELECT series, (h - hr) / nullif(h + m + f - hr, 0) AS equitable_threat_score FROM e"),
    "frequency_bias": ("frequency_bias", f"+{COUNTS} SELECT series, (h + f) / CAST(nullif(h + m, 0) AS DOUBLE) AS frequency_bias FROM e"),
}
for _title, (_column, _sql) in _SCORES.items():

    @register("series", _column, _sql, "pairs", _title)
    def _score(spark, d, title=_title):
        return getattr(metrics, title)(views.pairs(spark, d), keys=["series"], threshold=THRESHOLD)


@register("series hits misses false_alarms correct_negatives", "", f"+{COUNTS} SELECT series, h AS hits, m AS misses, f AS false_alarms, n AS correct_negatives FROM c", "pairs")
def contingency_table(spark, d):
    return metrics.contingency_table(views.pairs(spark, d), keys=["series"], threshold=THRESHOLD)


@register("series", "nse", "SELECT series, 1 - sum(pow(prediction - observation, 2)) / nullif(count(observation) * var_pop(observation), 0) AS nse FROM pairs GROUP BY series", "pairs")
def nse(spark, d):
    return metrics.nse(views.pairs(spark, d), keys=["series"])


def _probabilities(spark, d):
    return views.table(spark, d, "labels").select(F.col("quality").cast("double").alias("observation"), ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("probability"))


PROBABILITIES = "p AS (SELECT CAST(quality AS DOUBLE) AS o, (doc_id * 37 % 101) / 100.0::DOUBLE AS p FROM labels)"


@register("", "brier_score", f"WITH {PROBABILITIES} SELECT avg(pow(p - o, 2)) AS brier_score FROM p")
def brier_score(spark, d):
    return metrics.brier_score(_probabilities(spark, d))


BINS = f"{PROBABILITIES}, b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(o) AS mo FROM p WHERE o IS NOT NULL GROUP BY 1)"


@register("bin n", "mean_probability observed_frequency", f"WITH {BINS} SELECT bin, n, mp AS mean_probability, mo AS observed_frequency FROM b")
def reliability_table(spark, d):
    return metrics.reliability_table(_probabilities(spark, d))


@register("", "reliability resolution uncertainty", f"WITH {BINS}, t AS (SELECT sum(n) AS n, sum(n * mo) / sum(n) AS o FROM b) SELECT sum(b.n * pow(mp - mo, 2)) / any_value(t.n) AS reliability, sum(b.n * pow(mo - t.o, 2)) / any_value(t.n) AS resolution, any_value(t.o * (1 - t.o)) AS uncertainty FROM b, t")
def reliability_components(spark, d):
    return metrics.reliability_components(_probabilities(spark, d))


@register("time", "fss", "+x AS (SELECT time, lat_idx AS y, lon_idx AS x, CASE WHEN observation >= 900 THEN 1.0 ELSE 0.0 END::DOUBLE AS o, CASE WHEN prediction >= 900 THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM grid), f AS (SELECT a.time, a.y, a.x, avg(b.o) AS o, avg(b.p) AS p FROM x a JOIN x b ON a.time = b.time AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT time, 1 - avg(pow(p - o, 2)) / nullif(avg(p * p) + avg(o * o), 0) AS fss FROM f GROUP BY time", "grid")
def fractions_skill_score(spark, d):
    return metrics.fractions_skill_score(views.grid(spark, d), threshold=900.0, keys=["time"])


SCORE_NAMES = " ".join(V.SCORECARD[1:])


def _card(by: str, source: str, threshold: float) -> str:
    return (
        f"+a AS (SELECT *, coalesce(observation >= {threshold}, false) AS oe, coalesce(prediction >= {threshold}, false) AS pe FROM {source}), "
        f"r AS (SELECT {by}, avg(r) AS correlation FROM (SELECT {by}, latitude, longitude, covar_pop(observation, prediction) / nullif(stddev_pop(CASE WHEN prediction IS NOT NULL THEN observation END) * stddev_pop(CASE WHEN observation IS NOT NULL THEN prediction END), 0) AS r FROM a GROUP BY ALL) GROUP BY {by}), "
        f"c AS (SELECT {by}, count(observation) AS n_valid, avg(prediction - observation) AS bias, avg(abs(prediction - observation)) AS mae, sqrt(avg(pow(prediction - observation, 2))) AS rmse, sum(prediction) / nullif(sum(observation), 0) AS bias_ratio, count(*) FILTER (WHERE oe AND pe) AS h, count(*) FILTER (WHERE oe AND NOT pe) AS m, count(*) FILTER (WHERE NOT oe AND pe) AS f, count(*) FILTER (WHERE NOT oe AND NOT pe) AS n, CAST(count(*) AS DOUBLE) AS t FROM a GROUP BY {by}), "
        f"s AS (SELECT *, h / CAST(nullif(h + m, 0) AS DOUBLE) AS pod, h / CAST(nullif(h + f, 0) AS DOUBLE) AS sr, f / CAST(nullif(h + f, 0) AS DOUBLE) AS far, ((h + m) * (h + f) + (n + m) * (n + f)) / t AS ex, (h + m) * (h + f) / t AS hr FROM c), "
        f"card AS (SELECT {', '.join(f's.{b}' for b in by.split(', '))}, n_valid, bias, abs(bias) AS absolute_bias, mae, rmse, correlation, bias_ratio, pod, far, 2 * pod * sr / nullif(pod + sr, 0) AS f1, (h + n - ex) / nullif(t - ex, 0) AS heidke_skill_score, h / CAST(nullif(h + m + f, 0) AS DOUBLE) AS threat_score, (h - hr) / nullif(h + m + f - hr, 0) AS equitable_threat_score, (h + f) / CAST(nullif(h + m, 0) AS DOUBLE) AS frequency_bias FROM s JOIN r ON {' AND '.join(f's.{b} = r.{b}' for b in by.split(', '))})"
    )


GRID_THRESHOLD = 900.0


@register("dataset n_valid", SCORE_NAMES, f"{_card('dataset', 'products', GRID_THRESHOLD)} SELECT * FROM card", "products")
def compare_products(spark, d):
    return V.scorecard(views.products(spark, d), threshold=GRID_THRESHOLD)


@register("dataset n_valid", SCORE_NAMES, f"{_card('dataset', '''(SELECT * FROM products WHERE dataset = 'taxed')''', GRID_THRESHOLD)} SELECT * FROM card", "products")
def evaluate_product(spark, d):
    g = views.grid(spark, d)
    on = ["time", "latitude", "longitude"]
    return V.evaluate_product(g.select(*on, F.col("observation").alias("value")), g.select(*on, F.col("prediction").alias("value")), name="taxed", threshold=GRID_THRESHOLD)


_RANKED = ", ".join(
    f"coalesce({'' if up else '1 - '}(CASE WHEN {m} IS NULL THEN NULL WHEN max({m}) OVER () = min({m}) OVER () THEN 1 ELSE ({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0) END), 0) AS {m}_score" for m, up in V.HIGHER_IS_BETTER.items()
)
_SUM = " + ".join(f"{m}_score" for m in V.HIGHER_IS_BETTER)


@register("dataset rank", "composite_score", f"{_card('dataset', 'products', GRID_THRESHOLD)}, k AS (SELECT dataset, {_RANKED} FROM (SELECT dataset, {', '.join(f'round({m}, 9) AS {m}' for m in V.HIGHER_IS_BETTER)} FROM card)), q AS (SELECT dataset, ({_SUM}) / 8 AS composite_score FROM k) SELECT dataset, rank() OVER (ORDER BY composite_score DESC) AS rank, composite_score FROM q", "products")
def rank_products(spark, d):
    # Scores that are equal but for rounding of sums have to tie.
    card = V.scorecard(views.products(spark, d), threshold=GRID_THRESHOLD)
    out = V.rank_products(card.withColumns({m: F.round(m, 9) for m in V.HIGHER_IS_BETTER}))
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("dataset latitude longitude valid_count", "bias mae rmse correlation pod far frequency_bias", f"SELECT dataset, latitude, longitude, count(*) AS valid_count, avg(prediction - observation) AS bias, avg(abs(prediction - observation)) AS mae, sqrt(avg(pow(prediction - observation, 2))) AS rmse, covar_pop(observation, prediction) / nullif(stddev_pop(observation) * stddev_pop(prediction), 0) AS correlation, count(*) FILTER (WHERE observation >= {GRID_THRESHOLD} AND prediction >= {GRID_THRESHOLD}) / CAST(nullif(count(*) FILTER (WHERE observation >= {GRID_THRESHOLD}), 0) AS DOUBLE) AS pod, count(*) FILTER (WHERE observation < {GRID_THRESHOLD} AND prediction >= {GRID_THRESHOLD}) / CAST(nullif(count(*) FILTER (WHERE prediction >= {GRID_THRESHOLD}), 0) AS DOUBLE) AS far, count(*) FILTER (WHERE prediction >= {GRID_THRESHOLD}) / CAST(nullif(count(*) FILTER (WHERE observation >= {GRID_THRESHOLD}), 0) AS DOUBLE) AS frequency_bias FROM products GROUP BY ALL", "products")
def spatial_metrics(spark, d):
    return V.spatial_metrics(views.products(spark, d), threshold=GRID_THRESHOLD)


_SEASONS = "sn AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {m})" for s, ms in V.SEASONS.items() for m in ms) + ") v(period, m)), sp AS (SELECT products.*, period FROM products JOIN sn ON sn.m = month(time)), "


@register("dataset period n_valid", SCORE_NAMES, "+" + _SEASONS + _card("dataset, period", "sp", GRID_THRESHOLD)[1:] + " SELECT * FROM card", "products")
def seasonal_scores(spark, d):
    return V.seasonal_scores(views.products(spark, d), threshold=GRID_THRESHOLD)


_GRID_BINS = (("low", 0.0, 800.0), ("middle", 800.0, 1000.0), ("high", 1000.0, float("inf")))
_BINNED = "bn AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {lo}, {hi if hi < 1e30 else '1e300'})" for n, lo, hi in _GRID_BINS) + ") v(subset, lo, hi)), ib AS (SELECT dataset, subset, latitude, longitude, observation >= lo AND observation < hi AS inside, CASE WHEN observation >= lo AND observation < hi THEN observation END AS observation, CASE WHEN observation >= lo AND observation < hi THEN prediction END AS prediction FROM products, bn), ev AS (SELECT dataset AS ds, subset AS ss, count(*) FILTER (WHERE inside) AS n_events FROM ib GROUP BY ALL), "


@register("dataset subset n_events n_valid", SCORE_NAMES, "+" + _BINNED + _card("dataset, subset", "ib", GRID_THRESHOLD)[1:] + " SELECT * FROM card JOIN ev ON ds = dataset AND ss = subset", "products")
def intensity_scores(spark, d):
    return V.intensity_scores(views.products(spark, d), bins=_GRID_BINS, threshold=GRID_THRESHOLD)


@register("dataset metric n_resamples block_length", "lower_95 median upper_95")
def experiment_uncertainty(spark, d):
    return V.bootstrap_uncertainty(views.products(spark, d), threshold=GRID_THRESHOLD)


@register("dataset rank", "composite_score bias rmse equitable_threat_score")
def run_experiment(spark, d):
    g = views.grid(spark, d)
    on = [F.col("time").cast("timestamp_ntz").alias("time"), "latitude", "longitude"]
    products = {n: g.select(*on, c.alias("value")) for n, c in (("taxed", F.col("prediction")), ("low", F.col("observation") * 0.8), ("exact", F.col("observation")))}
    config = V.ExperimentConfig(reference=g.select(*on, F.col("observation").alias("value")), products=products, start="1995-01-01", end="2000-12-31", threshold=GRID_THRESHOLD)
    return V.manuscript_summary(V.run_experiment(config))


# --- labels, features, splits ------------------------------------------------------------------


@register("series time label", "", "SELECT series, time, CASE WHEN observation < 1 THEN 'dry' WHEN observation < 10 THEN 'light' WHEN observation < 20 THEN 'moderate' WHEN observation < 50 THEN 'heavy' WHEN observation < 100 THEN 'very_heavy' ELSE 'extreme' END AS label FROM pairs", "pairs")
def intensity_class(spark, d):
    return views.pairs(spark, d).withColumn("label", scalars.intensity_class(F.col("observation")))


ERROR = "CASE WHEN m <= -0.05 THEN 'underestimate_severe' WHEN m < -0.01 THEN 'underestimate_moderate' WHEN m >= 0.05 THEN 'overestimate_severe' WHEN m > 0.01 THEN 'overestimate_moderate' ELSE 'near_zero' END"
MEASURE = "(CASE WHEN abs(observation) > 1 THEN (prediction - observation) / abs(observation) ELSE prediction - observation END)"


@register("series time label", "", f"SELECT series, time, {ERROR} AS label FROM (SELECT *, {MEASURE} AS m FROM pairs)", "pairs")
def error_class(spark, d):
    return views.pairs(spark, d).withColumn("label", scalars.error_class(F.col("observation"), F.col("prediction"), relative_thresholds=(0.01, 0.05)))


@register("time label", "", "+z AS (SELECT time, (observation - avg(observation) OVER ()) / stddev_samp(observation) OVER () AS z FROM (SELECT time, sum(observation) AS observation FROM grid GROUP BY time)) SELECT time, CASE WHEN z <= -2 THEN 'extreme drought' WHEN z <= -1.5 THEN 'severe drought' WHEN z <= -1 THEN 'moderate drought' WHEN z < 1 THEN 'near normal' WHEN z < 1.5 THEN 'moderately wet' WHEN z < 2 THEN 'severely wet' ELSE 'extremely wet' END AS label FROM z", "grid")
def drought_category(spark, d):
    one = views.grid(spark, d).groupBy("time").agg(F.sum("observation").alias("value"))
    return drought.spi_like(one).withColumn("label", scalars.drought_category(F.col("spi_like")))


@register("series time observed_intensity_class observed_wet month year dayofyear season error_class", "observation prediction error absolute_error relative_error log_ratio", f"SELECT *, prediction - observation AS error, abs(prediction - observation) AS absolute_error, (prediction - observation) / nullif(abs(observation), 0) AS relative_error, ln(prediction / observation) AS log_ratio, CASE WHEN observation < 1 THEN 'dry' WHEN observation < 10 THEN 'light' WHEN observation < 20 THEN 'moderate' WHEN observation < 50 THEN 'heavy' WHEN observation < 100 THEN 'very_heavy' ELSE 'extreme' END AS observed_intensity_class, CAST(observation >= 1 AS BIGINT) AS observed_wet, CAST(month(time) AS BIGINT) AS month, CAST(year(time) AS BIGINT) AS year, CAST(dayofyear(time) AS BIGINT) AS dayofyear, CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) IN (3, 4, 5) THEN 'MAM' WHEN month(time) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, {ERROR} AS error_class FROM (SELECT *, {MEASURE} AS m FROM pairs)", "pairs")
def build_error_features(spark, d):
    out = tagging.build_error_features(views.pairs(spark, d), relative_thresholds=(0.01, 0.05))
    return out.withColumns({c: F.col(c).cast("long") for c in ("observed_wet", "month", "year", "dayofyear")})


_SPLIT = "CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split"


@register("series time split", "", f"+t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM pairs)) SELECT series, pairs.time, {_SPLIT} FROM pairs JOIN t ON t.time = pairs.time", "pairs")
def temporal_split(spark, d):
    return tagging.temporal_split(views.pairs(spark, d))


@register("o_orderkey split", "", f"WITH t AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, {_SPLIT} FROM orders JOIN t ON t.o_custkey = orders.o_custkey")
def event_group_split(spark, d):
    return tagging.event_group_split(views.table(spark, d, "orders"), group="o_custkey")


@register("latitude longitude split")
def spatial_block_split(spark, d):
    return tagging.spatial_block_split(views.grid(spark, d).select("latitude", "longitude").distinct(), lat_block=10.0, lon_block=10.0)


@register("", "accuracy balanced_accuracy f1_macro f1_weighted precision_macro recall_macro mcc", "WITH p AS (SELECT quality AS t, toxic AS p FROM labels), c AS (SELECT c, CAST(count(*) FILTER (WHERE t = c) AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE t = c AND p = c) AS DOUBLE) AS h FROM p, (SELECT DISTINCT unnest([t, p]) AS c FROM p) GROUP BY c), m AS (SELECT *, coalesce(h / nullif(t, 0), 0) AS r, coalesce(h / nullif(p, 0), 0) AS pr, coalesce(2 * h / nullif(t + p, 0), 0) AS f FROM c) SELECT sum(h) / sum(t) AS accuracy, avg(CASE WHEN t > 0 THEN r END) AS balanced_accuracy, avg(f) AS f1_macro, sum(f * t) / sum(t) AS f1_weighted, avg(pr) AS precision_macro, avg(r) AS recall_macro, coalesce((sum(h) * sum(t) - sum(t * p)) / nullif(sqrt(sum(t) * sum(t) - sum(p * p)) * sqrt(sum(t) * sum(t) - sum(t * t)), 0), 0) AS mcc FROM m")
def classification_metrics(spark, d):
    return tagging.classification_metrics(views.table(spark, d, "labels"), truth="quality", predicted="toxic")


# --- trends ------------------------------------------------------------------------------------

ORDERED = "y AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY time) AS k FROM annual), s AS (SELECT a.series, sum(sign(b.value - a.value)) AS s, median((b.value - a.value) / (b.k - a.k)) AS slope FROM y a JOIN y b ON a.series = b.series AND a.k < b.k GROUP BY a.series), t AS (SELECT series, sum(c * (c - 1)) / 2.0 AS tied, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT series, value, count(*) AS c FROM annual GROUP BY ALL) GROUP BY series)"


@register("series", "slope", f"+{ORDERED} SELECT series, slope FROM s", "annual")
def sens_slope(spark, d):
    return trends.sens_slope(views.annual(spark, d), keys=["series"])


@register("series n", "s tau", f"+{ORDERED} SELECT s.series, CAST(n AS BIGINT) AS n, s, s / sqrt(n * (n - 1) / 2.0 * (n * (n - 1) / 2.0 - tied)) AS tau FROM s JOIN t ON t.series = s.series", "annual")
def mann_kendall(spark, d):
    return trends.mann_kendall(views.annual(spark, d), keys=["series"])


@register("series", "var_s", f"+{ORDERED} SELECT series, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var_s FROM t", "annual")
def mk_variance(spark, d):
    return trends.mk_variance(views.annual(spark, d), keys=["series"])


@register("series n", "s tau", f"+{ORDERED} SELECT s.series, CAST(n AS BIGINT) AS n, s, s / sqrt(n * (n - 1) / 2.0 * (n * (n - 1) / 2.0 - tied)) AS tau FROM s JOIN t ON t.series = s.series", "annual")
def modified_mann_kendall(spark, d):
    return trends.modified_mann_kendall(views.annual(spark, d), keys=["series"])


@register("series", "slope", "+z AS (SELECT series, year(time) AS sy, CASE WHEN count(value) >= 92 THEN sum(value) END AS value FROM daily WHERE month(time) IN (6, 7, 8) GROUP BY ALL), y AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY sy) AS k FROM z WHERE value IS NOT NULL), p AS (SELECT a.series, median((b.value - a.value) / (b.k - a.k)) AS slope FROM y a JOIN y b ON a.series = b.series AND a.k < b.k GROUP BY a.series) SELECT g.series, slope FROM (SELECT DISTINCT series FROM z) g LEFT JOIN p ON p.series = g.series", "daily")
def seasonal_sen_slope(spark, d):
    return trends.seasonal_sen_slope(views.daily(spark, d), "JJA", keys=["series"])


@register("series n", "s tau pvalue n_eff")
def seasonal_mann_kendall(spark, d):
    return trends.seasonal_mann_kendall(views.daily(spark, d), "JJA", keys=["series"])


@register("l_orderkey l_linenumber significant_fdr", "", "WITH p AS (SELECT l_orderkey, l_linenumber, l_discount + (l_orderkey % 1000) / 1000.0::DOUBLE AS p FROM lineitem), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p), l AS (SELECT max(p) AS l FROM r WHERE p <= 0.2::DOUBLE * k / m) SELECT l_orderkey, l_linenumber, coalesce(p <= l, false) AS significant_fdr FROM r, l")
def fdr_mask(spark, d):
    p = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") + (F.col("l_orderkey") % 1000) / F.lit(1000.0)).alias("pvalue"))
    return trends.fdr_mask(p, 0.2)


@register("series time", "value")
def trend_free_prewhitening(spark, d):
    return trends.trend_free_prewhitening(views.monthly(spark, d), keys=["series"])


def _field(spark, d):
    return views.grid(spark, d).groupBy("latitude", "longitude", F.year("time").alias("time")).agg(F.sum("observation").alias("value"))


@register("latitude longitude n significant significant_fdr", "s tau pvalue n_eff slope")
def spatial_trend(spark, d):
    return trends.spatial_trend(_field(spark, d))


@register("n significant", "s tau pvalue n_eff slope")
def regional_trend(spark, d):
    return trends.regional_trend(_field(spark, d))


@register("n", "slope lower upper")
def regional_slope_ci(spark, d):
    return trends.regional_slope_ci(_field(spark, d))


@register("series n", "slope lower upper")
def sens_slope_ci(spark, d):
    return trends.sens_slope_ci(views.annual(spark, d), keys=["series"])


@register("observed_count n_cells critical_count", "field_pvalue")
def field_significance(spark, d):
    return trends.field_significance(_field(spark, d), block_length=2)


@register("series n", "hurst r_squared")
def dfa_hurst(spark, d):
    return trends.dfa_hurst(views.daily(spark, d), keys=["series"])


# --- extremes ----------------------------------------------------------------------------------

PEAK = 450.0


@register("series time", "value excess", f"SELECT series, time, value, value - {PEAK} AS excess FROM daily WHERE value > {PEAK}", "daily")
def pot_exceedances(spark, d):
    return extremes.pot_exceedances(views.daily(spark, d), PEAK)


@register("series time", "value", f"+a AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time) AS k FROM daily), b AS (SELECT *, k - lag(k) OVER (PARTITION BY series ORDER BY time) AS gap FROM a WHERE value > {PEAK}), c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY time) AS g FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY series, g ORDER BY value DESC, time) AS best FROM c) SELECT series, time, value FROM e WHERE best = 1", "daily")
def decluster_exceedances(spark, d):
    return extremes.decluster_exceedances(views.daily(spark, d), PEAK, 3, keys=["series"])


@register("series n_exceedances", "threshold exceedance_rate mean_excess", f"+u AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LEVELS)}]) AS threshold) SELECT series, threshold, count(*) FILTER (WHERE value > threshold) AS n_exceedances, count(*) FILTER (WHERE value > threshold) / CAST(count(value) AS DOUBLE) AS exceedance_rate, avg(value - threshold) FILTER (WHERE value > threshold) AS mean_excess FROM daily, u GROUP BY series, threshold", "daily")
def threshold_counts(spark, d):
    return extremes.threshold_counts(views.daily(spark, d), LEVELS, keys=["series"])


@register("series n_exceedances", "threshold exceedance_rate mean_excess shape scale")
def threshold_diagnostics(spark, d):
    return extremes.threshold_diagnostics(views.daily(spark, d), LEVELS, keys=["series"])


@register("p_partkey", "level", "WITH x AS (SELECT p_partkey, (p_partkey % 9 - 4) / 10.0::DOUBLE AS s, 1.0::DOUBLE + p_size AS c FROM part) SELECT p_partkey, CASE WHEN abs(s) < 1e-8 THEN 100 + c * ln(20.0::DOUBLE) ELSE 100 + c / s * (pow(20.0::DOUBLE, s) - 1) END AS level FROM x")
def pot_return_level(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 9 - 4) / F.lit(10.0)).alias("s"), (F.lit(1.0) + F.col("p_size")).alias("c"))
    return p.withColumn("level", scalars.pot_return_level(F.lit(100.0), F.col("s"), F.col("c"), F.lit(0.2), F.lit(100.0)))


@register("p_partkey", "level", "WITH x AS (SELECT p_partkey, (p_partkey % 9 - 4) / 10.0::DOUBLE AS s, 1.0::DOUBLE + p_size AS c, -ln(1 - 1 / 50.0::DOUBLE) AS l FROM part) SELECT p_partkey, CASE WHEN abs(s) < 1e-8 THEN 100 - c * ln(l) ELSE 100 + c / s * (pow(l, -s) - 1) END AS level FROM x")
def gev_return_level(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 9 - 4) / F.lit(10.0)).alias("s"), (F.lit(1.0) + F.col("p_size")).alias("c"))
    return p.withColumn("level", scalars.gev_return_level(F.col("s"), F.lit(100.0), F.col("c"), F.lit(50.0)))


def _excess(spark, d):
    rows = extremes.pot_exceedances(views.daily(spark, d), 400.0)
    return rows.withColumn("covariate", F.dayofyear("time").cast("double"))


def _maxima(spark, d):
    return views.daily(spark, d).groupBy("series", F.date_trunc("MONTH", "time").alias("time")).agg(F.max("value").alias("value"))


@register("series n", "shape scale")
def gpd_fit(spark, d):
    return extremes.gpd_fit(_excess(spark, d), keys=["series"])


@register("series n", "shape xi loc scale")
def gev_fit(spark, d):
    return extremes.gev_fit(_maxima(spark, d), keys=["series"])


@register("series n", "return_level ci_lower ci_upper")
def gev_return_level_ci(spark, d):
    return extremes.gev_return_level_ci(_maxima(spark, d), 50.0, keys=["series"])


@register("series n_exceedances", "return_level ci_lower ci_upper shape scale exceedance_rate")
def pot_return_level_ci(spark, d):
    return extremes.pot_return_level_ci(views.daily(spark, d), 400.0, 3650.0, keys=["series"])


@register("series n_exceedances", "threshold return_level")
def pot_threshold_sensitivity(spark, d):
    return extremes.pot_threshold_sensitivity(views.daily(spark, d), LEVELS, 3650.0, keys=["series"])


@register("series threshold_count", "return_level_min return_level_median return_level_max")
def pot_threshold_uncertainty(spark, d):
    return extremes.pot_threshold_uncertainty(views.daily(spark, d), LEVELS, 3650.0, keys=["series"])


@register("series n_exceedances", "ks_statistic ks_pvalue ad_statistic")
def gpd_goodness_of_fit(spark, d):
    return extremes.gpd_goodness_of_fit(_excess(spark, d), keys=["series"])


@register("series rank", "pit qq_observed qq_theoretical")
def gpd_quantiles(spark, d):
    return extremes.gpd_quantiles(_excess(spark, d), keys=["series"])


@register("series n_exceedances", "ks_statistic ks_pvalue_bootstrap ad_statistic ad_pvalue_bootstrap")
def gpd_goodness_of_fit_bootstrap(spark, d):
    return extremes.gpd_goodness_of_fit_bootstrap(_excess(spark, d), keys=["series"])


@register("series n_exceedances", "shape log_scale_intercept log_scale_covariate covariate_mean covariate_std nll")
def gpd_fit_nonstationary(spark, d):
    return extremes.gpd_fit_nonstationary(_excess(spark, d), keys=["series"])


@register("series n_exceedances", "aic_stationary aic_nonstationary bic_stationary bic_nonstationary lr_statistic lr_pvalue")
def gpd_model_comparison(spark, d):
    return extremes.gpd_model_comparison(_excess(spark, d), keys=["series"])


@register("series n_exceedances", "lr_statistic lr_pvalue lr_pvalue_bootstrap lr_critical")
def gpd_model_comparison_bootstrap(spark, d):
    return extremes.gpd_model_comparison_bootstrap(_excess(spark, d), keys=["series"])


@register("series n_exceedances", "shape shape_ci_lower shape_ci_upper log_scale_covariate log_scale_covariate_ci_lower log_scale_covariate_ci_upper")
def gpd_nonstationary_ci(spark, d):
    return extremes.gpd_nonstationary_ci(_excess(spark, d), keys=["series"])


@register("series n_valid_bootstrap", "return_level_median ci_lower ci_upper selected_threshold_median")
def pot_threshold_bootstrap(spark, d):
    return extremes.pot_threshold_bootstrap(views.daily(spark, d), LEVELS, 3650.0, keys=["series"])


# --- drought, learning -------------------------------------------------------------------------


@register("series time", "spi_like", "+a AS (SELECT series, time, CASE WHEN count(value) OVER w = 3 THEN sum(value) OVER w END AS v FROM monthly WINDOW w AS (PARTITION BY series ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT series, time, (v - avg(v) OVER (PARTITION BY series)) / nullif(stddev_samp(v) OVER (PARTITION BY series), 0) AS spi_like FROM a", "monthly")
def spi_like(spark, d):
    return drought.spi_like(views.monthly(spark, d), 3, keys=["series"])


@register("series time", "spi")
def spi(spark, d):
    return drought.spi(views.monthly(spark, d), 3, keys=["series"], min_samples=5)


@register("series time", "spi")
def spi_pearson3(spark, d):
    return drought.spi(views.monthly(spark, d), 3, keys=["series"], min_samples=5, distribution="pearson3")


@register("series time", "spei")
def spei(spark, d):
    m = views.monthly(spark, d)
    return drought.spei(m.withColumns({"precipitation": F.col("value"), "pet": F.lit(5000.0) + 100.0 * F.month("time")}), 3, keys=["series"], min_samples=5)


@register("series n", "mean std normality_pvalue")
def fit_quality(spark, d):
    return drought.fit_quality(drought.spi_like(views.monthly(spark, d), 3, keys=["series"]), value="spi_like", keys=["series"])


def _features(spark, d):
    rows = tagging.build_error_features(views.pairs(spark, d), relative_thresholds=(0.0, 0.05)).withColumn("group", F.date_format("time", "yyyy-MM"))
    return rows.withColumn("label", (F.col("error") > 0).cast("int").cast("string"))


@register("label n", "hits")
def fit_classifier(spark, d):
    data = _features(spark, d)
    names = ["prediction", "month", "dayofyear"]
    fitted = learning.fit_classifier(data, names, "label", numTrees=20, maxDepth=5)
    return learning.predict(fitted, data).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("hits"))


@register("fold", "accuracy balanced_accuracy f1_macro")
def cross_validate_classifier(spark, d):
    return learning.cross_validate_classifier(_features(spark, d), ["prediction", "month", "dayofyear"], "label", group="group", n_splits=3, numTrees=10, maxDepth=4)


@register("feature", "importance_mean importance_std")
def permutation_importance(spark, d):
    data = _features(spark, d)
    names = ["prediction", "month"]
    fitted = learning.fit_classifier(data, names, "label", numTrees=10, maxDepth=4)
    return learning.permutation_importance(fitted, data, names, "label", n_repeats=2)
