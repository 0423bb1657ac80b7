"""Block maxima and peaks over thresholds."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.scalars import pot_return_level as level_column
from ..functions.scalars import return_level
from ..model import nan_to_null, per_series, ratio, series
from .trends import by_series

D, L = "double", "long"


def pot_exceedances(df: DataFrame, threshold: float, *, value: str = "value") -> DataFrame:
    """The rows above the threshold, with excess."""
    return df.filter(F.col(value) > threshold).withColumn("excess", F.col(value) - F.lit(float(threshold)))


def decluster_exceedances(df: DataFrame, threshold: float, run_length: int = 3, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """The first maximum of each cluster; a cluster ends after ``run_length`` rows without an exceedance."""
    if run_length < 1:
        raise ValueError("run_length must be positive")
    w = series(keys, time)
    rows = df.withColumn("__row", F.row_number().over(w)).filter(F.col(value) > threshold)
    starts = F.coalesce(F.col("__row") - F.lag("__row").over(w) > run_length, F.lit(True))
    rows = rows.withColumn("__new", starts.cast("int")).withColumn("cluster", F.sum("__new").over(w))
    best = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy(F.col(value).desc(), F.col(time)))
    return rows.withColumn("__best", best).filter("__best = 1").drop("__row", "__new", "__best")


def _thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    values = [float(t) for t in thresholds]
    if not values or not all(map(math.isfinite, values)):
        raise ValueError("thresholds must be a non-empty finite sequence")
    return df.withColumn("threshold", F.explode(F.array(*map(F.lit, values))))


def threshold_counts(df: DataFrame, thresholds: Sequence[float], *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, threshold, n_exceedances, exceedance_rate, mean_excess)."""
    rows = _thresholds(df.select(*keys, F.col(value).cast(D).alias("v")), thresholds)
    over = F.col("v") > F.col("threshold")
    out = rows.groupBy(*keys, "threshold").agg(F.count_if(over).alias("n_exceedances"), F.count("v").alias("__n"), F.avg(F.when(over, F.col("v") - F.col("threshold"))).alias("mean_excess"))
    return out.select(*keys, "threshold", "n_exceedances", ratio(F.col("n_exceedances"), F.col("__n")).alias("exceedance_rate"), "mean_excess")


def threshold_diagnostics(df: DataFrame, thresholds: Sequence[float], *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``threshold_counts`` with shape and scale of the excesses; a task a series and threshold."""
    rows = _thresholds(df.select(*keys, F.col(value).cast(D).alias("v")), thresholds)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = float(pdf["threshold"].iloc[0]), pdf["v"].to_numpy(float, na_value=np.nan)
        v = v[np.isfinite(v)]
        y = v[v > u] - u
        shape, scale, n = K.gpd_fit(y)
        return pd.DataFrame([(n, n / v.size if v.size else K.NAN, y.mean() if n else K.NAN, shape, scale)], columns=["n_exceedances", "exceedance_rate", "mean_excess", "shape", "scale"])

    return nan_to_null(per_series(rows, [*keys, "threshold"], work, "n_exceedances long, exceedance_rate double, mean_excess double, shape double, scale double"))


def pot_threshold_sensitivity(df: DataFrame, thresholds: Sequence[float], return_period: float, *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``threshold_diagnostics`` with the return level of each threshold."""
    if not (math.isfinite(return_period) and return_period > 0):
        raise ValueError("return_period must be positive and finite")
    out = threshold_diagnostics(df, thresholds, value=value, keys=keys)
    return out.withColumn("return_level", level_column(F.col("threshold"), F.col("shape"), F.col("scale"), F.col("exceedance_rate"), F.lit(float(return_period))))


def pot_threshold_uncertainty(df: DataFrame, thresholds: Sequence[float], return_period: float, *, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, return_level_min, _median, _max, threshold_count): the envelope over thresholds."""
    out = pot_threshold_sensitivity(df, thresholds, return_period, value=value, keys=keys)
    x = "return_level"
    return out.groupBy(*keys).agg(F.min(x).alias(f"{x}_min"), F.median(x).alias(f"{x}_median"), F.max(x).alias(f"{x}_max"), F.count(x).alias("threshold_count"))


def gpd_fit(df: DataFrame, *, value: str = "excess", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, shape, scale, n) of excesses; fewer than five give null."""
    return by_series(df, keys, K.gpd_fit, (("shape", D), ("scale", D), ("n", L)), value=value, time=time)


def gev_fit(df: DataFrame, *, value: str = "value", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, shape, xi, loc, scale, n) of block maxima; shape is -xi, and xi goes into return levels."""

    def kernel(y: np.ndarray):
        xi, loc, scale, n = K.gev_fit(y)
        return -xi, xi, loc, scale, n

    return by_series(df, keys, kernel, (("shape", D), ("xi", D), ("loc", D), ("scale", D), ("n", L)), value=value, time=time)


def _check(alpha: float, n_resamples: int) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if n_resamples < 100:
        raise ValueError("n_resamples must be at least 100")


def _interval(levels: np.ndarray, alpha: float, n_resamples: int) -> tuple[float, float]:
    levels = levels[np.isfinite(levels)]
    if levels.size < max(50, n_resamples // 2):
        return K.NAN, K.NAN
    low, high = np.quantile(levels, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def gev_return_level_ci(df: DataFrame, return_period: float, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), alpha: float = 0.05, n_resamples: int = 1000, random_state: int = 0, reference_compat: bool = False) -> DataFrame:
    """Rows (keys, return_level, ci_lower, ci_upper, n) by parametric bootstrap.

    ``reference_compat`` puts the shape of opposite sign into the level formula.
    """
    _check(alpha, n_resamples)
    sign = -1 if reference_compat else 1

    def kernel(y: np.ndarray):
        xi, loc, scale, n = K.gev_fit(y)
        if not (math.isfinite(scale) and scale > 0):
            return K.NAN, K.NAN, K.NAN, n
        samples = K.gev_sample(xi, loc, scale, (n_resamples, n), np.random.default_rng(random_state))
        levels = np.full(n_resamples, np.nan)
        for k, sample in enumerate(samples):
            x, m, s, _ = K.gev_fit(sample)
            if math.isfinite(s) and s > 0:
                levels[k] = K.gev_level(sign * x, m, s, return_period)
        return K.gev_level(sign * xi, loc, scale, return_period), *_interval(levels, alpha, n_resamples), n

    return by_series(df, keys, kernel, (("return_level", D), ("ci_lower", D), ("ci_upper", D), ("n", L)), value=value, time=time)


def _level(shape: float, scale: float, threshold: float, rate: float, period: float) -> float:
    try:
        return return_level(threshold, shape, scale, rate, period)
    except (ValueError, OverflowError):
        return K.NAN


def pot_return_level_ci(df: DataFrame, threshold: float, return_period: float, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), decluster_run_length: int | None = None, n_resamples: int = 1000, alpha: float = 0.05, random_state: int = 0) -> DataFrame:
    """Rows (keys, return_level, ci_lower, ci_upper, shape, scale, n_exceedances, exceedance_rate).

    The excesses are resampled at a fixed rate: of rows, or of clusters if declustered.
    """
    _check(alpha, n_resamples)
    totals = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    peaks = decluster_exceedances(df, threshold, decluster_run_length, value=value, time=time, keys=keys) if decluster_run_length is not None else df.filter(F.col(value) > threshold)
    peaks = peaks.select(*keys, time, (F.col(value) - threshold).alias("excess"))
    rows = peaks.join(totals, list(keys)) if keys else peaks.crossJoin(F.broadcast(totals))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y, n = pdf.sort_values(time, kind="stable")["excess"].to_numpy(float), int(pdf["__n"].iloc[0])
        shape, scale, count = K.gpd_fit(y)
        rate = count / n
        rng = np.random.default_rng(random_state)
        if not math.isfinite(scale):
            row = (K.NAN, K.NAN, K.NAN, K.NAN, K.NAN, count, K.NAN)
        else:
            if rate * return_period <= 1:
                raise ValueError("return_period must exceed the recurrence interval of exceedances")
            levels = np.array([_level(*K.gpd_fit(rng.choice(y, count))[:2], threshold, rate, return_period) for _ in range(n_resamples)])
            row = (_level(shape, scale, threshold, rate, return_period), *_interval(levels, alpha, n_resamples), shape, scale, count, rate)
        return pd.DataFrame([row], columns=["return_level", "ci_lower", "ci_upper", "shape", "scale", "n_exceedances", "exceedance_rate"])

    return nan_to_null(per_series(rows, keys, work, "return_level double, ci_lower double, ci_upper double, shape double, scale double, n_exceedances long, exceedance_rate double"))


def gpd_goodness_of_fit(df: DataFrame, *, value: str = "excess", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, ks_statistic, ks_pvalue, ad_statistic, n_exceedances)."""

    def kernel(y: np.ndarray):
        y = K.clean(y)
        shape, scale, n = K.gpd_fit(y)
        if not math.isfinite(scale):
            return K.NAN, K.NAN, K.NAN, n
        _, ks, ad = K.gpd_tests(y, shape, scale)
        return ks, K.ks_pvalue(ks, n), ad, n

    return by_series(df, keys, kernel, (("ks_statistic", D), ("ks_pvalue", D), ("ad_statistic", D), ("n_exceedances", L)), value=value, time=time)


def gpd_quantiles(df: DataFrame, *, value: str = "excess", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, rank, pit, qq_observed, qq_theoretical), one for each excess."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.sort(pdf[value].to_numpy(float))
        shape, scale, n = K.gpd_fit(y)
        if not math.isfinite(scale):
            return pd.DataFrame({"rank": [], "pit": [], "qq_observed": [], "qq_theoretical": []})
        return pd.DataFrame({"rank": np.arange(1, n + 1), "pit": K.gpd_cdf(shape, scale, y), "qq_observed": y, "qq_theoretical": K.gpd_ppf(shape, scale, (np.arange(1, n + 1) - 0.5) / n)})

    rows = df.select(*keys, F.col(value).cast(D).alias(value)).filter(F.col(value).isNotNull())
    return per_series(rows, keys, work, "rank long, pit double, qq_observed double, qq_theoretical double")


def gpd_goodness_of_fit_bootstrap(df: DataFrame, *, value: str = "excess", time: str = "time", keys: Sequence[str] = (), n_resamples: int = 1000, alpha: float = 0.05, random_state: int = 0) -> DataFrame:
    """Rows (keys, ks_statistic, ks_pvalue_bootstrap, ad_statistic, ad_pvalue_bootstrap, n_exceedances)."""
    _check(alpha, n_resamples)

    def kernel(y: np.ndarray):
        y = K.clean(y)
        shape, scale, n = K.gpd_fit(y)
        if not math.isfinite(scale):
            return K.NAN, K.NAN, K.NAN, K.NAN, n
        _, ks, ad = K.gpd_tests(y, shape, scale)
        rng, above = np.random.default_rng(random_state), np.zeros(2)
        for _ in range(n_resamples):
            x = K.gpd_ppf(shape, scale, rng.random(n))
            s, c, _ = K.gpd_fit(x)
            _, a, b = K.gpd_tests(x, s, c)
            above += (a >= ks, b >= ad)
        p = (1 + above) / (n_resamples + 1)
        return ks, float(p[0]), ad, float(p[1]), n

    return by_series(df, keys, kernel, (("ks_statistic", D), ("ks_pvalue_bootstrap", D), ("ad_statistic", D), ("ad_pvalue_bootstrap", D), ("n_exceedances", L)), value=value, time=time)


def _pairs(df: DataFrame, keys: Sequence[str], kernel, columns: Sequence[tuple[str, str]], value: str, covariate: str, time: str) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        return pd.DataFrame([kernel(pdf[value].to_numpy(float, na_value=np.nan), pdf[covariate].to_numpy(float, na_value=np.nan))], columns=[c for c, _ in columns])

    rows = df.select(*keys, time, F.col(value).cast(D).alias(value), F.col(covariate).cast(D).alias(covariate))
    return nan_to_null(per_series(rows, keys, work, ", ".join(f"{c} {t}" for c, t in columns)))


def gpd_fit_nonstationary(df: DataFrame, *, value: str = "excess", covariate: str = "covariate", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, shape, log_scale_intercept, log_scale_covariate, covariate_mean, covariate_std, n_exceedances, nll)."""

    def kernel(y, x):
        y, z, mean, sd = K.clean_pair(y, x)
        p, nll = K.gpd_fit_covariate(y, z)
        return *map(float, p), mean, sd, int(y.size), nll

    return _pairs(df, keys, kernel, (("shape", D), ("log_scale_intercept", D), ("log_scale_covariate", D), ("covariate_mean", D), ("covariate_std", D), ("n_exceedances", L), ("nll", D)), value, covariate, time)


COMPARISON = (("loglik_stationary", D), ("loglik_nonstationary", D), ("aic_stationary", D), ("aic_nonstationary", D), ("bic_stationary", D), ("bic_nonstationary", D), ("lr_statistic", D), ("lr_pvalue", D), ("shape_stationary", D), ("scale_stationary", D), ("shape_nonstationary", D), ("log_scale_intercept", D), ("log_scale_covariate", D), ("n_exceedances", L))


def compare_models(y: np.ndarray, z: np.ndarray) -> tuple:
    shape, scale, n = K.gpd_fit(y)
    plain = -K.gpd_nll(shape, scale, y)
    p, nll = K.gpd_fit_covariate(y, z)
    lr = max(0.0, 2 * (-nll - plain))
    return plain, -nll, 4 - 2 * plain, 6 + 2 * nll, 2 * math.log(n) - 2 * plain, 3 * math.log(n) + 2 * nll, lr, K.chi2_1_sf(lr), shape, scale, *map(float, p), n


def gpd_model_comparison(df: DataFrame, *, value: str = "excess", covariate: str = "covariate", time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, likelihoods, AIC, BIC, likelihood ratio and its p-value, parameters, n_exceedances)."""
    return _pairs(df, keys, lambda y, x: compare_models(*K.clean_pair(y, x)[:2]), COMPARISON, value, covariate, time)


def gpd_model_comparison_bootstrap(df: DataFrame, *, value: str = "excess", covariate: str = "covariate", time: str = "time", keys: Sequence[str] = (), n_resamples: int = 500, alpha: float = 0.05, random_state: int = 0) -> DataFrame:
    """``gpd_model_comparison`` with lr_pvalue_bootstrap and lr_critical under the stationary model."""
    _check(alpha, n_resamples)

    def kernel(y, x):
        y, z, _, _ = K.clean_pair(y, x)
        row = compare_models(y, z)
        rng = np.random.default_rng(random_state)
        null = np.array([compare_models(K.gpd_ppf(row[8], row[9], rng.random(y.size)), z)[6] for _ in range(n_resamples)])
        return *row, float((1 + np.sum(null >= row[6])) / (n_resamples + 1)), float(np.quantile(null, 1 - alpha))

    return _pairs(df, keys, kernel, (*COMPARISON, ("lr_pvalue_bootstrap", D), ("lr_critical", D)), value, covariate, time)


#: So many resamples of a series are one group, in one of at least so many partitions, which Spark does not put together again.
RESAMPLES, PARTITIONS = 50, 100


def gpd_nonstationary_ci(df: DataFrame, *, value: str = "excess", covariate: str = "covariate", time: str = "time", keys: Sequence[str] = (), n_resamples: int = 500, alpha: float = 0.05, random_state: int = 0) -> DataFrame:
    """Rows (keys, three parameters, each with ci_lower and ci_upper, n_exceedances) by parametric bootstrap.

    A series is fitted again in each group of its resamples, which go on in one stream of draws.
    """
    _check(alpha, n_resamples)
    names = ("shape", "log_scale_intercept", "log_scale_covariate")
    resampled = [f"__{n}" for n in names]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["__first"].iloc[0])
        pdf = pdf.sort_values([time, value, covariate], kind="stable")
        y, z, _, _ = K.clean_pair(pdf[value].to_numpy(float, na_value=np.nan), pdf[covariate].to_numpy(float, na_value=np.nan))
        p, _ = K.gpd_fit_covariate(y, z)
        scale, rng = np.exp(p[1] + p[2] * z), np.random.default_rng(random_state)
        rng.bit_generator.advance(first * y.size)
        fits = [K.gpd_fit_covariate(K.gpd_ppf(p[0], 1.0, rng.random(y.size)) * scale, z)[0] for _ in range(min(RESAMPLES, n_resamples - first))]
        return pd.DataFrame([(*p, int(y.size), *fit) for fit in fits], columns=[*names, "n_exceedances", *resampled])

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        fits = pdf[resampled].to_numpy(float, na_value=np.nan)
        fits = fits[np.isfinite(fits).all(axis=1)]
        row = pdf[[*names, "n_exceedances"]].head(1).reset_index(drop=True)
        for k, n in enumerate(names):
            row[f"{n}_ci_lower"], row[f"{n}_ci_upper"] = _interval(fits[:, k], alpha, n_resamples)
        return row

    firsts = F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1), F.lit(RESAMPLES)))
    rows = df.select(*keys, time, F.col(value).cast(D).alias(value), F.col(covariate).cast(D).alias(covariate), firsts.alias("__first"))
    rows = rows.repartition(max(PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, "__first")
    each = per_series(rows, [*keys, "__first"], draw, ", ".join([*(f"{n} double" for n in names), "n_exceedances long", *(f"{n} double" for n in resampled)]))
    columns = ", ".join([*(f"{n} double" for n in names), *(f"{n}_{b} double" for n in names for b in ("ci_lower", "ci_upper")), "n_exceedances long"])
    return nan_to_null(per_series(each, keys, bounds, columns))


def pot_threshold_bootstrap(df: DataFrame, thresholds: Sequence[float], return_period: float, *, value: str = "value", time: str = "time", keys: Sequence[str] = (), n_resamples: int = 500, alpha: float = 0.05, random_state: int = 0) -> DataFrame:
    """Rows (keys, return_level_median, ci_lower, ci_upper, selected_threshold_median, n_valid_bootstrap).

    Each resample refits all thresholds and takes the one of smallest AIC.
    """
    _check(alpha, n_resamples)
    if return_period <= 0:
        raise ValueError("return_period must be positive")
    limits = [float(t) for t in thresholds]
    if not limits or not all(map(math.isfinite, limits)):
        raise ValueError("thresholds must be a non-empty finite sequence")

    def kernel(y: np.ndarray):
        y = K.clean(y)
        if y.size < 20:
            raise ValueError("at least 20 values are required")
        rng, chosen = np.random.default_rng(random_state), []
        for _ in range(n_resamples):
            sample = rng.choice(y, y.size)
            best = (math.inf, K.NAN, K.NAN)
            for u in limits:
                e = sample[sample > u] - u
                shape, scale, n = K.gpd_fit(e)
                if math.isfinite(scale):
                    best = min(best, (4 + 2 * K.gpd_nll(shape, scale, e), u, _level(shape, scale, u, n / y.size, return_period)))
            if math.isfinite(best[2]):
                chosen.append(best[1:])
        if len(chosen) < max(50, n_resamples // 2):
            raise RuntimeError("too few valid resamples")
        u, levels = np.array(chosen).T
        low, middle, high = np.quantile(levels, [alpha / 2, 0.5, 1 - alpha / 2])
        return float(middle), float(low), float(high), float(np.median(u)), len(chosen)

    return by_series(df, keys, kernel, (("return_level_median", D), ("ci_lower", D), ("ci_upper", D), ("selected_threshold_median", D), ("n_valid_bootstrap", L)), value=value, time=time)


def pot_diagnostic_report(diagnostics: DataFrame, **tables: DataFrame) -> str:
    """A self-contained HTML page of small result tables (thresholds, tests): one row each is shown."""
    parts = []
    for title, table in {"diagnostics": diagnostics, **tables}.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{x:.6g}' if isinstance(x, float) else str(x))}</td>" for x in row) + "</tr>" for row in table.toLocalIterator())
        parts.append(f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Peaks over thresholds</title></head><body>{''.join(parts)}</body></html>"
