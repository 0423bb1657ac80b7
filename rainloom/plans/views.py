"""Climate views of the star-schema tables: what the queries run on, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, key: str = "l_returnflag") -> DataFrame:
    """(series, time, value): quantity by day, in mm."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col(key).alias("series"), F.to_date("l_shipdate").alias("time"))
    return rows.agg(F.sum("l_quantity").alias("value")).withMetadata("value", {"units": "mm", "standard_name": "precipitation_amount"}).withMetadata("time", {"frequency": "daily"})


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.to_date(F.date_trunc("MONTH", "l_shipdate")).alias("time"))
    return rows.agg(F.sum("l_quantity").alias("value")).withMetadata("value", {"units": "mm", "standard_name": "precipitation_amount"}).withMetadata("time", {"frequency": "monthly"})


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, time, value): quantity by supplier nation and year; time is the year."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("series"))
    rows = table(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey").groupBy("series", F.year("l_shipdate").alias("time"))
    return rows.agg(F.sum("l_quantity").alias("value"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, time, observation, prediction) by day."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("time"))
    return rows.agg(F.sum("l_quantity").alias("observation"), F.sum(F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("prediction"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, lat_idx, lon_idx, latitude, longitude, observation, prediction) by month on 5 x 5 cells."""
    lat, lon = F.col("l_suppkey") % 5, F.col("l_partkey") % 5
    rows = table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("MONTH", "l_shipdate")).alias("time"), lat.alias("lat_idx"), lon.alias("lon_idx"))
    out = rows.agg(F.sum("l_quantity").alias("observation"), F.sum(F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("prediction"))
    return out.withColumns({"latitude": 10.0 + 5 * F.col("lat_idx"), "longitude": 70.0 + 5 * F.col("lon_idx")})


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, time, latitude, longitude, observation, prediction): three products beside ``grid``."""
    scales = {"exact": F.col("observation"), "taxed": F.col("prediction"), "low": F.col("observation") * 0.8 - 3}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dataset"), e.alias("prediction")) for n, e in scales.items()]))
    return grid(spark, sf_dir).select("time", "latitude", "longitude", "observation", each.alias("s")).select("s.dataset", "time", "latitude", "longitude", "observation", "s.prediction")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, time, value) of events by type and hour."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time"))
    return rows.agg(F.sum("value").alias("value"))


SQL = {
    "daily": "SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS time, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "sparse": "SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS time, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "monthly": "SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS time, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "annual": "SELECT CAST(s_nationkey AS BIGINT) AS series, year(l_shipdate) AS time, sum(l_quantity) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "pairs": "SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS time, sum(l_quantity) AS observation, sum(l_quantity * (1 + l_tax - l_discount)) AS prediction FROM lineitem GROUP BY ALL",
    "grid": "SELECT *, 10.0::DOUBLE + 5 * lat_idx AS latitude, 70.0::DOUBLE + 5 * lon_idx AS longitude FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, l_suppkey % 5 AS lat_idx, l_partkey % 5 AS lon_idx, sum(l_quantity) AS observation, sum(l_quantity * (1 + l_tax - l_discount)) AS prediction FROM lineitem GROUP BY ALL)",
    "hourly": "SELECT event_type AS series, date_trunc('hour', ts) AS time, sum(value) AS value FROM events GROUP BY ALL",
}
SQL["products"] = f"SELECT 'exact' AS dataset, time, latitude, longitude, observation, observation AS prediction FROM ({SQL['grid']}) UNION ALL SELECT 'taxed', time, latitude, longitude, observation, prediction FROM ({SQL['grid']}) UNION ALL SELECT 'low', time, latitude, longitude, observation, observation * 0.8::DOUBLE - 3 FROM ({SQL['grid']})"


def with_views(sql: str, *names: str) -> str:
    """``sql`` over the named views; it may begin with more common table expressions after ``+``."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head}, {sql[1:]}" if sql.startswith("+") else f"WITH {head} {sql}"
