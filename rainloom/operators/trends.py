"""Trend tests and slopes of series, false-discovery control, field significance, DFA."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import nan_to_null, per_series, running_before, same
from .climatology import seasonal_series
from .spatial import regional_mean


def by_series(df: DataFrame, keys: Sequence[str], kernel, columns: Sequence[tuple[str, str]], *, value: str = "value", time: str = "time") -> DataFrame:
    """Rows (keys, columns...): ``kernel(values in order of time)`` of each series, NaN as null."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(time, kind="stable")[value].to_numpy(float, na_value=np.nan)
        return pd.DataFrame([kernel(values)], columns=[c for c, _ in columns])

    rows = df.select(*keys, time, F.col(value).cast("double").alias(value))
    return nan_to_null(per_series(rows, keys, work, ", ".join(f"{c} {t}" for c, t in columns)))


def mann_kendall(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, s, tau, pvalue, n); a series with a missing value has only n."""
    return by_series(df, keys, K.mann_kendall, (("s", "double"), ("tau", "double"), ("pvalue", "double"), ("n", "long")), value=value, time=time)


def modified_mann_kendall(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), max_lag: int | None = None) -> DataFrame:
    """Rows (keys, s, tau, pvalue, n_eff, n) with the variance corrected for autocorrelation."""
    return by_series(df, keys, functools.partial(K.modified_mk, max_lag=max_lag), (("s", "double"), ("tau", "double"), ("pvalue", "double"), ("n_eff", "double"), ("n", "long")), value=value, time=time)


def sens_slope(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, slope): the median of the pairwise slopes per step of the valid values."""
    return by_series(df, keys, lambda y: (K.sen_slope(y),), (("slope", "double"),), value=value, time=time)


def mk_variance(df: DataFrame, *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, var_s) from counts of ties, with DataFrame functions."""
    ties = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    term = lambda n: n * (n - 1) * (2 * n + 5)
    out = ties.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(term(F.col("c"))).alias("tied"))
    return out.select(*keys, ((term(F.col("n")) - F.col("tied")) / 18.0).alias("var_s"))


def sens_slope_ci(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), alpha: float = 0.05, n_resamples: int = 1000, block_length: int | None = None, random_state: int = 0) -> DataFrame:
    """Rows (keys, slope, lower, upper, n); each series has its own generator of the same seed."""
    kernel = functools.partial(K.sen_slope_ci, alpha=alpha, resamples=n_resamples, block_length=block_length, seed=random_state)
    return by_series(df, keys, kernel, (("slope", "double"), ("lower", "double"), ("upper", "double"), ("n", "long")), value=value, time=time)


def trend_free_prewhitening(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, time, value) for the valid times: the series without its AR(1) part."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(time, kind="stable")
        return pd.DataFrame({time: pdf[time].to_numpy(), "value": K.prewhitened(pdf[value].to_numpy(float))})

    rows = df.select(*keys, time, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    return nan_to_null(per_series(rows, keys, work, f"`{time}` {df.schema[time].dataType.simpleString()}, value double"), "value")


def seasonal_mann_kendall(df: DataFrame, season: str, *, keys: Sequence[str] = (), max_lag: int | None = None, **options: object) -> DataFrame:
    """The modified test of the seasonal series; ``options`` go to ``seasonal_series``."""
    return modified_mann_kendall(seasonal_series(df, season, keys=keys, **options), time="season_year", keys=keys, max_lag=max_lag)


def seasonal_sen_slope(df: DataFrame, season: str, *, keys: Sequence[str] = (), **options: object) -> DataFrame:
    return sens_slope(seasonal_series(df, season, keys=keys, **options), time="season_year", keys=keys)


def fdr_mask(df: DataFrame, alpha: float = 0.05, *, pvalue: str = "pvalue", within: Sequence[str] = (), name: str = "significant_fdr") -> DataFrame:
    """``df`` with the Benjamini-Hochberg decision within ``within``; null p-values do not count and do not pass.

    The rank of a p-value is the number of those up to it.  Only distinct ones up to ``alpha`` can be
    the limit; they are ranked in bins of their logarithm (1,024 an octave), not in one window.
    """
    p, names = F.col(pvalue), [f"__g{k}" for k in range(len(within))]
    held = df.select(*[F.col(g).alias(n) for g, n in zip(within, names, strict=True)], p.alias("__p"))
    levels = held.filter(F.col("__p") <= alpha).groupBy(*names, "__p").agg(F.count(F.lit(1)).alias("__n"))
    octaves = F.coalesce(F.floor(F.log2(F.col("__p") / F.lit(alpha)) * 1024), F.lit(-(1 << 30))).cast("long")
    ranked = running_before(levels, "__n", "__p", octaves, names, "__before").withColumn("__k", F.col("__before") + F.col("__n"))
    totals = held.groupBy(*names).agg(F.count("__p").alias("__m"))
    others = [f"__t{k}" for k in range(len(names))]
    ranked = ranked.join(totals.select(*[F.col(n).alias(o) for n, o in zip(names, others, strict=True)], "__m"), same(names, others))
    limits = ranked.filter(F.col("__p") <= F.lit(alpha) * F.col("__k") / F.col("__m")).groupBy(*names).agg(F.max("__p").alias("__limit"))
    out = df.join(limits if within else F.broadcast(limits), same(within, names), "left")
    return out.withColumn(name, F.coalesce(p <= F.col("__limit"), F.lit(False))).drop("__limit", *names)


def spatial_trend(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ("latitude", "longitude"), alpha: float = 0.05, max_lag: int | None = None) -> DataFrame:
    """Rows (keys, s, tau, pvalue, n_eff, n, slope, significant, significant_fdr); one pass of kernels."""
    columns = (("s", "double"), ("tau", "double"), ("pvalue", "double"), ("n_eff", "double"), ("n", "long"), ("slope", "double"))
    out = by_series(df, keys, lambda y: (*K.modified_mk(y, max_lag), K.sen_slope(y)), columns, value=value, time=time)
    return fdr_mask(out.withColumn("significant", F.coalesce(F.col("pvalue") < alpha, F.lit(False))), alpha)


def regional_trend(df: DataFrame, *, value: str = "value", time: str = "time", lat: str = "latitude", lon: str = "longitude", weights: DataFrame | None = None, alpha: float = 0.05, max_lag: int | None = None) -> DataFrame:
    """One row of the modified test and Sen slope of the weighted regional series."""
    one = regional_mean(df, value=value, time=time, lat=lat, lon=lon, weights=weights)
    columns = (("s", "double"), ("tau", "double"), ("pvalue", "double"), ("n_eff", "double"), ("n", "long"), ("slope", "double"))
    out = by_series(one, (), lambda y: (*K.modified_mk(y, max_lag), K.sen_slope(y)), columns, time=time)
    return out.withColumn("significant", F.coalesce(F.col("pvalue") < alpha, F.lit(False)))


def regional_slope_ci(df: DataFrame, *, value: str = "value", time: str = "time", lat: str = "latitude", lon: str = "longitude", weights: DataFrame | None = None, **options: object) -> DataFrame:
    return sens_slope_ci(regional_mean(df, value=value, time=time, lat=lat, lon=lon, weights=weights), time=time, **options)


def field_significance(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ("latitude", "longitude"), alpha: float = 0.05, block_length: int = 5, n_resamples: int = 500, random_state: int = 0, detrend: bool = True) -> DataFrame:
    """One row (observed_count, n_cells, critical_count, field_pvalue) of a moving-block test of a field.

    Cells with a value at every time take part.  Every resample draws one set of times for all
    cells, which keeps their dependence.  Each cell counts its significant resamples in its own
    task as a vector over resamples; the vectors are added up by aggregation, so the field is
    never gathered anywhere.
    """
    times = df.select(time).distinct().count()
    rng = np.random.default_rng(random_state)
    draws = [K.moving_blocks(times, block_length, rng) for _ in range(n_resamples)] if times else []

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time, kind="stable")[value].to_numpy(float, na_value=np.nan)
        if y.size != times or not np.isfinite(y).all():
            return pd.DataFrame({"resample": [], "hit": []}).astype("int64")
        p = K.modified_mk(y)[2]
        rest = y
        if detrend:
            rest = y - K.sen_slope(y) * np.arange(y.size)
            rest = rest - np.median(rest)
        hits = [int(math.isfinite(p) and p < alpha), *(int(math.isfinite(q := K.mann_kendall(rest[d])[2]) and q < alpha) for d in draws)]
        return pd.DataFrame({"resample": range(-1, len(draws)), "hit": hits})

    rows = df.select(*keys, time, F.col(value).cast("double").alias(value))
    found = per_series(rows, keys, work, "resample long, hit long")
    sums = found.groupBy("resample").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("cells"))
    seen = F.max(F.when(F.col("resample") == -1, F.col("hits"))).over(Window.partitionBy())
    null = F.col("resample") >= 0
    ranked = sums.withColumn("seen", seen).withColumn("k", F.row_number().over(Window.orderBy(null.desc(), "hits")))
    place = math.ceil((n_resamples - 1) * (1 - alpha)) + 1
    return ranked.agg(
        F.max("seen").alias("observed_count"),
        F.max("cells").alias("n_cells"),
        F.max(F.when(null & (F.col("k") == place), F.col("hits"))).alias("critical_count"),
        ((F.count_if(null & (F.col("hits") >= F.col("seen"))) + 1) / F.lit(n_resamples + 1.0)).alias("field_pvalue"),
    )


def dfa_hurst(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), order: int = 1, min_scale: int = 8, max_scale: int | None = None, n_scales: int = 20) -> DataFrame:
    """Rows (keys, hurst, r_squared, n) of detrended fluctuation analysis."""
    kernel = functools.partial(K.dfa, order=order, min_scale=min_scale, max_scale=max_scale, n_scales=n_scales)
    return by_series(df, keys, kernel, (("hurst", "double"), ("r_squared", "double"), ("n", "long")), value=value, time=time)
