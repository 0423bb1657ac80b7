"""Scorecards, rankings and the declarative verification experiment."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import moving_blocks
from ..model import ratio
from .metrics import correlation_of, event, expressions
from .spatial import regrid
from .tagging import build_error_features

#: Intensity bins, seasons, regions and the ranking's metrics.
INTENSITY_BINS = (("dry", 0.0, 1.0), ("light", 1.0, 10.0), ("moderate", 10.0, 20.0), ("heavy", 20.0, 50.0), ("very_heavy", 50.0, 100.0), ("extreme", 100.0, math.inf))
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11), "JJAS": (6, 7, 8, 9)}
REGIONS = {"odisha": (17.7, 22.6, 81.3, 87.5), "india": (6.0, 37.5, 68.0, 97.5)}
HIGHER_IS_BETTER = {"absolute_bias": False, "mae": False, "rmse": False, "correlation": True, "pod": True, "far": False, "f1": True, "threat_score": True}
SCORECARD = ("n_valid", "bias", "absolute_bias", "mae", "rmse", "correlation", "bias_ratio", "pod", "far", "f1", "heidke_skill_score", "threat_score", "equitable_threat_score", "frequency_bias")
BOOTSTRAPPED = ("bias", "mae", "rmse", "correlation", "pod", "far", "f1", "threat_score")


def period(df: DataFrame, start: str | None, end: str | None, *, time: str = "time") -> DataFrame:
    """Rows of an inclusive period; an end that is a date has its whole day.  Filters on the raw column, so it is pushed to the scan."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        whole = len(end) <= 10
        last = F.lit(end).cast("timestamp_ntz")
        df = df.filter(F.col(time) < last + F.expr("INTERVAL 1 DAY") if whole else F.col(time) <= last)
    return df


def subset_region(df: DataFrame, region: str | Sequence[float] | None, *, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows in a named box or (lat_min, lat_max, lon_min, lon_max), bounds included."""
    if region is None:
        return df
    if isinstance(region, str) and region.lower() not in REGIONS:
        raise ValueError(f"unknown region {region!r}")
    a, b, c, d = REGIONS[region.lower()] if isinstance(region, str) else region
    return df.filter(F.col(lat).between(min(a, b), max(a, b)) & F.col(lon).between(min(c, d), max(c, d)))


def subset_odisha(df: DataFrame, bbox: Sequence[float] = REGIONS["odisha"], **names: str) -> DataFrame:
    return subset_region(df, bbox, **names)


def align_period(reference: DataFrame, candidate: DataFrame, *, on: Sequence[str] = ("time", "latitude", "longitude"), value: str = "value") -> DataFrame:
    """Rows (on, observation, prediction) of the coordinates both have."""
    left = reference.select(*on, F.col(value).cast("double").alias("observation"))
    return left.join(candidate.select(*on, *[c for c in ("dataset",) if c in candidate.columns], F.col(value).cast("double").alias("prediction")), list(on))


def common_grid(reference: DataFrame, candidate: DataFrame, *, method: str = "linear", value: str = "value", lat: str = "latitude", lon: str = "longitude", keys: Sequence[str] = ("time",)) -> DataFrame:
    return regrid(candidate, reference.select(lat, lon).distinct(), method=method, value=value, lat=lat, lon=lon, keys=keys)


def scorecard(pairs: DataFrame, by: Sequence[str] = ("dataset",), *, cells: Sequence[str] = ("latitude", "longitude"), threshold: float = 1.0) -> DataFrame:
    """Rows (by, n_valid, scores...) of pairs.

    The correlation is the mean over cells of the correlation in time; everything else is added
    up from sums of the cells, so all of it is one shuffle by cell and a small one.
    """
    o, p = F.col("observation"), F.col("prediction")
    a, b = event(o, threshold), event(p, threshold)
    e = p - o
    each = pairs.groupBy(*by, *cells).agg(
        correlation_of(o, p).alias("r"),
        F.count(o).alias("n_valid"),
        F.count(e).alias("n"),
        F.sum(e).alias("e"),
        F.sum(F.abs(e)).alias("ae"),
        F.sum(e * e).alias("ee"),
        F.sum(o).alias("o"),
        F.sum(p).alias("p"),
        *[F.count_if(c).alias(n) for n, c in (("h", a & b), ("m", a & ~b), ("f", ~a & b), ("c", ~a & ~b))],
    )
    s = lambda c: F.sum(c)
    h, m, f, c = (s(x) for x in "hmfc")
    total = h + m + f + c
    pod, sr = ratio(h, h + m), ratio(h, h + f)
    by_chance = ratio((h + m) * (h + f) + (c + m) * (c + f), total)
    random_hits = ratio((h + m) * (h + f), total)
    bias = ratio(s("e"), s("n"))
    values = {
        "n_valid": s("n_valid"),
        "bias": bias,
        "absolute_bias": F.abs(bias),
        "mae": ratio(s("ae"), s("n")),
        "rmse": F.sqrt(ratio(s("ee"), s("n"))),
        "correlation": F.avg("r"),
        "bias_ratio": ratio(s("p"), s("o")),
        "pod": pod,
        "far": ratio(f, h + f),
        "f1": ratio(2 * pod * sr, pod + sr),
        "heidke_skill_score": ratio(h + c - by_chance, total - by_chance),
        "threat_score": ratio(h, h + m + f),
        "equitable_threat_score": ratio(h - random_hits, h + m + f - random_hits),
        "frequency_bias": ratio(h + f, h + m),
    }
    return each.groupBy(*by).agg(*[v.alias(k) for k, v in values.items()])


def evaluate_product(reference: DataFrame, candidate: DataFrame, *, name: str = "candidate", threshold: float = 1.0, on: Sequence[str] = ("time", "latitude", "longitude"), value: str = "value") -> DataFrame:
    """The one row of a product's scorecard."""
    pairs = align_period(reference, candidate, on=on, value=value).withColumn("dataset", F.lit(name))
    return scorecard(pairs, cells=[c for c in on if c != "time"], threshold=threshold)


def compare_products(reference: DataFrame, products: Mapping[str, DataFrame] | DataFrame, *, threshold: float = 1.0, common_grid_method: str | None = None, on: Sequence[str] = ("time", "latitude", "longitude"), value: str = "value") -> DataFrame:
    """Scorecards of all products in one pass; a table has a column dataset."""
    if not isinstance(products, DataFrame):
        products = stacked({n: common_grid(reference, d, method=common_grid_method, value=value) if common_grid_method else d for n, d in products.items()})
    return scorecard(align_period(reference, products, on=on, value=value), cells=[c for c in on if c != "time"], threshold=threshold)


def stacked(products: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in products.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def rank_products(scores: DataFrame, *, metrics: Sequence[str] | None = None, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``scores`` with <metric>_score, composite_score and rank, best first and by name.

    Scores are min-max over the products; where all are equal the score is 1, and lower-is-better
    metrics are inverted after that.  A missing score is 0 and keeps its weight.
    """
    names = [m for m in (metrics or HIGHER_IS_BETTER) if m in scores.columns]
    if not names:
        raise ValueError("no ranking metric is in the table")
    weight = {m: float((weights or {}).get(m, 1.0)) for m in names}
    if min(weight.values()) < 0 or not sum(weight.values()):
        raise ValueError("weights must not be negative, and not all be 0")
    every = Window.partitionBy()

    def scaled(m: str) -> Column:
        low, high = F.min(m).over(every), F.max(m).over(every)
        x = F.when(F.col(m).isNotNull(), F.when(high == low, 1.0).otherwise((F.col(m) - low) / F.when(high != low, high - low)))
        return x if HIGHER_IS_BETTER.get(m, True) else 1 - x

    out = scores.withColumns({f"{m}_score": scaled(m) for m in names})
    composite = sum((F.coalesce(F.col(f"{m}_score"), F.lit(0.0)) * weight[m] for m in names), F.lit(0.0)) / sum(weight.values())
    out = out.withColumn("composite_score", composite)
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.col("composite_score").desc()))).orderBy("rank", "dataset")


def spatial_metrics(pairs: DataFrame, *, by: Sequence[str] = ("dataset",), cells: Sequence[str] = ("latitude", "longitude"), threshold: float = 1.0) -> DataFrame:
    """Scores of each cell over the pairs where both are valid."""
    valid = pairs.filter(F.col("observation").isNotNull() & F.col("prediction").isNotNull())
    known = expressions(F.col("observation"), F.col("prediction"), threshold)
    names = ("bias", "mae", "rmse", "correlation", "pod", "far", "frequency_bias")
    return valid.groupBy(*by, *cells).agg(*[known[n].alias(n) for n in names], F.count(F.lit(1)).alias("valid_count"))


def seasonal_scores(pairs: DataFrame, *, seasons: Mapping[str, Sequence[int]] = SEASONS, cells: Sequence[str] = ("latitude", "longitude"), threshold: float = 1.0) -> DataFrame:
    """Scorecards by dataset and period; a row is counted in each season that has its month."""
    months = F.create_map(*[x for m in range(1, 13) for x in (F.lit(m), F.array(*[F.lit(s) for s, ms in seasons.items() if m in ms]).cast("array<string>"))])
    return scorecard(pairs.withColumn("period", F.explode(F.element_at(months, F.month("time")))), ("dataset", "period"), cells=cells, threshold=threshold)


def intensity_scores(pairs: DataFrame, *, bins: Sequence[tuple[str, float, float]] = INTENSITY_BINS, cells: Sequence[str] = ("latitude", "longitude"), threshold: float = 1.0) -> DataFrame:
    """Scorecards by dataset and observed intensity with n_events.

    Pairs outside a bin stay in it as missing pairs, which are correct negatives.
    """
    named = F.array(*[F.struct(F.lit(n).alias("subset"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, lo, hi in bins])
    rows = pairs.withColumn("__bin", F.explode(named))
    inside = F.coalesce((F.col("observation") >= F.col("__bin.lo")) & (F.col("observation") < F.col("__bin.hi")), F.lit(False))
    rows = rows.select("dataset", *cells, F.col("__bin.subset").alias("subset"), inside.alias("inside"), F.when(inside, F.col("observation")).alias("observation"), F.when(inside, F.col("prediction")).alias("prediction"))
    events = rows.groupBy("dataset", "subset").agg(F.count_if("inside").alias("n_events"))
    return scorecard(rows, ("dataset", "subset"), cells=cells, threshold=threshold).join(events, ["dataset", "subset"])


def bootstrap_uncertainty(pairs: DataFrame, *, resamples: int = 1000, block_length: int = 7, random_state: int = 0, cells: Sequence[str] = ("latitude", "longitude"), threshold: float = 1.0) -> DataFrame:
    """Rows (dataset, metric, lower_95, median, upper_95, n_resamples, block_length) by circular blocks of times.

    Times are a dimension.  A resample is how often it takes each time, so sums by cell and time
    stay as they are and only (cell, time) rows meet the multiplicities.
    """
    times = [r[0] for r in pairs.select("time").distinct().orderBy("time").collect()]
    n = len(times)
    spark = pairs.sparkSession
    names = "dataset string, metric string, lower_95 double, median double, upper_95 double, n_resamples long, block_length long"
    if n < 3 or resamples <= 0:
        return spark.createDataFrame([], names)
    rng = np.random.default_rng(random_state)
    table = [(t, np.zeros(resamples, np.int64)) for t in times]
    for k in range(resamples):
        for i, c in zip(*np.unique(moving_blocks(n, block_length, rng, circular=True), return_counts=True), strict=True):
            table[i][1][k] = c
    drawn = spark.createDataFrame([(t, [(int(k), int(c[k])) for k in np.flatnonzero(c)]) for t, c in table], f"time {pairs.schema['time'].dataType.simpleString()}, draws array<struct<k: long, w: long>>")
    rows = pairs.join(F.broadcast(drawn) if n * resamples <= 2_000_000 else drawn, "time").select("dataset", *cells, "observation", "prediction", F.explode("draws").alias("d")).select("dataset", *cells, "observation", "prediction", "d.k", "d.w")
    o, p, w = F.col("observation"), F.col("prediction"), F.col("w")
    both = o.isNotNull() & p.isNotNull()
    a, b = event(o, threshold), event(p, threshold)
    x, y, u = (F.when(both, v) for v in (o, p, w))
    each = rows.groupBy("dataset", "k", *cells).agg(
        *[F.sum(u * v).alias(n) for n, v in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y), ("e", y - x), ("ae", F.abs(y - x)))],
        *[F.sum(F.when(v, w).otherwise(0)).alias(n) for n, v in (("h", a & b), ("m", a & ~b), ("f", ~a & b))],
    )
    vx, vy = F.col("xx") - F.col("x") ** 2 / F.col("n"), F.col("yy") - F.col("y") ** 2 / F.col("n")
    each = each.withColumn("r", F.when((vx > 1e-12) & (vy > 1e-12), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(F.abs(vx * vy))))
    s = F.sum
    h, m, f = s("h"), s("m"), s("f")
    ee = s(F.col("yy") - 2 * F.col("xy") + F.col("xx"))
    pod, sr = ratio(h, h + m), ratio(h, h + f)
    scored = {"bias": ratio(s("e"), s("n")), "mae": ratio(s("ae"), s("n")), "rmse": F.sqrt(ratio(F.greatest(ee, F.lit(0.0)), s("n"))), "correlation": F.avg("r"), "pod": pod, "far": ratio(f, h + f), "f1": ratio(2 * pod * sr, pod + sr), "threat_score": ratio(h, h + m + f)}
    runs = each.groupBy("dataset", "k").agg(*[v.alias(n) for n, v in scored.items()])
    long = runs.select("dataset", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in scored])).alias("s")).select("dataset", "s.metric", "s.v")
    return long.groupBy("dataset", "metric").agg(F.percentile("v", F.lit(0.025)).alias("lower_95"), F.median("v").alias("median"), F.percentile("v", F.lit(0.975)).alias("upper_95"), F.lit(resamples).cast("long").alias("n_resamples"), F.lit(block_length).cast("long").alias("block_length"))


@dataclass(frozen=True)
class ExperimentConfig:
    """What to compare: ``reference`` and ``products`` are long tables (time, latitude, longitude, value)."""

    reference: DataFrame
    products: Mapping[str, DataFrame]
    start: str | None = None
    end: str | None = None
    region: str | tuple[float, float, float, float] | None = None
    threshold: float = 1.0
    regrid_method: str | None = None
    seasons: Mapping[str, Sequence[int]] = field(default_factory=lambda: dict(SEASONS))
    intensity_bins: Sequence[tuple[str, float, float]] = INTENSITY_BINS
    uncertainty_resamples: int = 0
    block_length: int = 7
    random_state: int = 0
    reference_name: str = "reference"


@dataclass(frozen=True)
class ExperimentResult:
    overall: DataFrame
    seasonal: DataFrame
    intensity: DataFrame
    ranking: DataFrame
    spatial: DataFrame
    error_features: DataFrame
    uncertainty: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self.__dataclass_fields__}


def run_experiment(config: ExperimentConfig) -> ExperimentResult:
    """The whole protocol over one table of matched pairs; filters reach the scans of all products."""
    inside = lambda df: subset_region(period(df, config.start, config.end), config.region)
    reference = inside(config.reference)
    products = {}
    for name, df in config.products.items():
        df = period(df, config.start, config.end)
        products[name] = common_grid(reference, df, method=config.regrid_method) if config.regrid_method else subset_region(df, config.region)
    pairs = align_period(reference, stacked(products)).persist()
    overall = scorecard(pairs, threshold=config.threshold).withColumns({"period": F.lit("all"), "subset": F.lit("all")})
    return ExperimentResult(
        overall=overall,
        seasonal=seasonal_scores(pairs, seasons=config.seasons, threshold=config.threshold),
        intensity=intensity_scores(pairs, bins=config.intensity_bins, threshold=config.threshold),
        ranking=rank_products(overall),
        spatial=spatial_metrics(pairs, threshold=config.threshold),
        error_features=build_error_features(pairs),
        uncertainty=bootstrap_uncertainty(pairs, resamples=config.uncertainty_resamples, block_length=config.block_length, random_state=config.random_state, threshold=config.threshold),
    )


def odisha_experiment(*, imd: DataFrame, start: str = "2000-06-01", end: str = "2018-12-31", uncertainty_resamples: int = 1000, block_length: int = 7, random_state: int = 0, regrid_method: str | None = "conservative", **products: DataFrame) -> ExperimentConfig:
    """The regional preset: seasons MAM, JJAS and ON against the reference ``imd``."""
    for d in (start, end):
        date.fromisoformat(d)
    return ExperimentConfig(reference=imd, products=products, start=start, end=end, region="odisha", regrid_method=regrid_method, seasons={"MAM": (3, 4, 5), "JJAS": (6, 7, 8, 9), "ON": (10, 11)}, uncertainty_resamples=uncertainty_resamples, block_length=block_length, random_state=random_state, reference_name="imd")


def save_experiment(result: ExperimentResult, output: str, *, prefix: str = "precipitation_comparison") -> dict[str, str]:
    """CSV of the tables and Parquet of the fields, by Spark's writers; returns their paths."""
    paths = {}
    for name, df in result.tables().items():
        kind = "parquet" if name in ("spatial", "error_features") else "csv"
        paths[name] = f"{output.rstrip('/')}/{prefix}_{name}.{kind}"
        writer = df.write.mode("overwrite")
        writer.parquet(paths[name]) if kind == "parquet" else writer.option("header", True).csv(paths[name])
    return paths


def manuscript_summary(result: ExperimentResult, *, reference_name: str | None = None) -> DataFrame:
    """The main scores of each product with its composite score and rank."""
    columns = ("bias", "mae", "rmse", "correlation", "pod", "far", "f1", "heidke_skill_score", "threat_score", "equitable_threat_score")
    out = result.overall.select("dataset", *columns).join(result.ranking.select("dataset", "composite_score", "rank"), "dataset", "left")
    return out.withColumn("reference", F.lit(reference_name)) if reference_name else out
