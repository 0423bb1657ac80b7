"""The tidy tables behind the figures of a verification report; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, rows: str, columns: str, metric: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns).agg(F.first(metric)).orderBy(rows)


def seasonal_heatmap(seasonal: DataFrame, metric: str = "rmse") -> DataFrame:
    """dataset x period."""
    return pivot(seasonal, "dataset", "period", metric)


def intensity_distribution(intensity: DataFrame, metric: str = "bias") -> DataFrame:
    """subset x dataset."""
    return pivot(intensity, "subset", "dataset", metric)


def ranking_heatmap(ranking: DataFrame) -> DataFrame:
    """The numeric scores of each dataset, best first."""
    return ranking.select("dataset", *[c for c in ranking.columns if c.endswith("_score")], "rank").orderBy("rank", "dataset")


def spatial_metric_panels(spatial: DataFrame, metric: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """Rows (dataset, latitude, longitude, metric)."""
    out = spatial.select("dataset", "latitude", "longitude", metric)
    return out.filter(F.col("dataset").isin(list(datasets))) if datasets else out


def scorecard_bars(scores: DataFrame, metrics: Sequence[str] = ("bias", "mae", "rmse", "correlation", "pod", "far", "f1", "threat_score")) -> DataFrame:
    """Rows (dataset, metric, value)."""
    return scores.select("dataset", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select("dataset", "s.*")


def uncertainty_bars(uncertainty: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """The medians with lengths of the error bars."""
    out = uncertainty.withColumns({"below": F.col("median") - F.col("lower_95"), "above": F.col("upper_95") - F.col("median")})
    return out.filter(F.col("metric").isin(list(metrics))) if metrics else out


def error_feature_distribution(features: DataFrame, metric: str = "error", max_points: int = 100_000, seed: int = 0) -> DataFrame:
    """A random sample of at most ``max_points`` values by dataset and intensity, for box plots."""
    return features.select("dataset", "observed_intensity_class", metric).filter(F.col(metric).isNotNull()).orderBy(F.rand(seed)).limit(max_points)
