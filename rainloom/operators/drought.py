"""Standardised drought indices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import nan_to_null, per_series, ratio, series
from .timeaxis import month_of
from .trends import by_series


def _scale(scale: int) -> int:
    if int(scale) != scale or scale < 1:
        raise ValueError("scale must be a positive integer")
    return int(scale)


def accumulated(df: DataFrame, scale: int, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """``df`` with sums over ``scale`` rows, null until all are there."""
    w = series(keys, time).rowsBetween(1 - _scale(scale), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == scale, F.sum(value).over(w)))


def _standardised(df: DataFrame, kernel, *, time: str, keys: Sequence[str], start: str | None, end: str | None, clip: float | None, name: str) -> DataFrame:
    """Fit by series and calendar month over the calibration period; each month is a task of its own."""
    inside = F.lit(True)
    if start:
        inside = inside & (F.to_date(time) >= F.lit(start).cast("date"))
    if end:
        inside = inside & (F.to_date(time) <= F.lit(end).cast("date"))
    rows = df.select(*keys, time, F.col("value").cast("double").alias("value"), month_of(df, time).alias("month"), inside.alias("calibration"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float, na_value=np.nan)
        cdf = kernel(x, K.clean(x[pdf["calibration"].to_numpy(bool)]))
        z = np.full(x.size, np.nan)
        good = np.isfinite(cdf)
        z[good] = K.norm_ppf(np.clip(cdf[good], 1e-8, 1 - 1e-8))
        return pd.DataFrame({time: pdf[time].to_numpy(), name: np.clip(z, -clip, clip) if clip is not None else z})

    out = per_series(rows, [*keys, "month"], work, f"`{time}` {df.schema[time].dataType.simpleString()}, {name} double")
    return nan_to_null(out, name)


def spi(df: DataFrame, scale: int = 3, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), distribution: str = "gamma", calibration_start: str | None = None, calibration_end: str | None = None, min_samples: int = 10, min_nonzero: int | None = None, clip: float | None = 8.0) -> DataFrame:
    """Rows (keys, month, time, spi); months with too few (positive) samples are null, negative input raises."""
    if distribution.lower() not in ("gamma", "pearson3", "pearson_iii", "pearson-iii"):
        raise ValueError("distribution must be 'gamma' or 'pearson3'")
    need = max(3, min_samples // 2) if min_nonzero is None else int(min_nonzero)

    def kernel(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
        out = np.full(x.size, np.nan)
        wet = fit[fit > 0]
        if fit.size < min_samples or wet.size < need:
            return out
        dry = 1 - wet.size / fit.size
        out[np.isfinite(x)] = dry
        above = np.isfinite(x) & (x > 0)
        if distribution.lower() == "gamma":
            a, s = K.gamma_fit(wet)
            part = np.array([K.gamma_cdf(a, v / s) for v in x[above]])
        else:
            part = K.pearson3_cdf(*K.pearson3_fit(wet), x[above])
        out[above] = dry + (1 - dry) * part
        return out

    guarded = df.withColumn(value, F.when(F.col(value) < 0, F.raise_error(F.lit("precipitation must be non-negative")).cast("double")).otherwise(F.col(value)))
    return _standardised(accumulated(guarded, scale, value=value, time=time, keys=keys), kernel, time=time, keys=keys, start=calibration_start, end=calibration_end, clip=clip, name="spi")


def spei(df: DataFrame, scale: int = 3, *, precipitation: str = "precipitation", pet: str = "pet", time: str = "time", keys: Sequence[str] = (), calibration_start: str | None = None, calibration_end: str | None = None, min_samples: int = 10, clip: float | None = 8.0) -> DataFrame:
    """Rows (keys, month, time, spei) of the water balance under a three-parameter log-logistic fit."""

    def kernel(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
        out = np.full(x.size, np.nan)
        if fit.size >= min_samples:
            good = np.isfinite(x)
            out[good] = K.loglogistic_cdf(*K.loglogistic_fit(fit), x[good])
        return out

    balance = df.withColumn("value", F.col(precipitation) - F.col(pet))
    return _standardised(accumulated(balance, scale, time=time, keys=keys), kernel, time=time, keys=keys, start=calibration_start, end=calibration_end, clip=clip, name="spei")


def spi_like(df: DataFrame, scale: int = 1, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with spi_like: the rolling sum less its mean, over its standard deviation."""
    out = accumulated(df, scale, value=value, time=time, keys=keys, name="__sum")
    every = Window.partitionBy(*keys)
    return out.withColumn("spi_like", ratio(F.col("__sum") - F.avg("__sum").over(every), F.stddev_samp("__sum").over(every))).drop("__sum")


def fit_quality(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, n, mean, std, normality_pvalue): Kolmogorov-Smirnov against the standard normal."""

    def kernel(y: np.ndarray):
        y = K.clean(y)
        if y.size < 3:
            return int(y.size), K.NAN, K.NAN, K.NAN
        return int(y.size), float(y.mean()), float(y.std(ddof=1)), K.ks_pvalue(K.ks_statistic(np.array([1 - K.norm_sf(v) for v in y])), y.size)

    return by_series(df, keys, kernel, (("n", "long"), ("mean", "double"), ("std", "double"), ("normality_pvalue", "double")), value=value, time=time)
