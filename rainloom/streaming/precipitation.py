"""Structured Streaming forms of daily totals and of declustering.

They go beyond the batch operators: late rows are accepted within the watermark only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_daily_amount(stream: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Rows (keys, time, value, samples) of each day, final once the watermark has passed it."""
    days = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, "1 day"))
    out = days.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"), F.count(value).alias("samples"))
    return out.select(*keys, F.to_date("window.start").alias("time"), "value", "samples")


def streaming_clusters(stream: DataFrame, threshold: float, gap: str, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Rows (keys, start, end, peak, exceedances): sessions of exceedances no more than ``gap`` apart."""
    over = stream.filter(F.col(value) > threshold).withWatermark(time, delay)
    out = over.groupBy(*keys, F.session_window(time, gap).alias("s")).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("exceedances"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "peak", "exceedances")
