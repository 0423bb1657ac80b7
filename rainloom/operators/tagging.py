"""Features and labels of prediction errors, leakage-safe splits, classification scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import INTENSITY_THRESHOLDS, error_class, intensity_class
from ..model import ratio, running_before


def build_error_features(observed: DataFrame, predicted: DataFrame | None = None, *, observation: str = "observation", prediction: str = "prediction", time: str = "time", on: Sequence[str] = (), elevation: DataFrame | None = None, include_target: bool = True, intensity_thresholds: Sequence[float] = INTENSITY_THRESHOLDS, relative_thresholds: tuple[float, float] = (0.25, 0.5), absolute_tolerance: float = 1.0) -> DataFrame:
    """Pairs with error, absolute_error, relative_error, log_ratio, intensity, wetness, date parts and class.

    ``predicted`` is joined on the coordinates ``on``; ``elevation`` (rows of some of them) too.
    """
    df = observed if predicted is None else observed.join(predicted, list(on))
    if elevation is not None:
        df = df.join(elevation, [c for c in on if c in elevation.columns], "left")
    o, p = F.col(observation), F.col(prediction)
    month = F.month(time)
    season = F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")
    valid = (o > 0) & (p > 0)
    features = {
        "error": p - o,
        "absolute_error": F.abs(p - o),
        "relative_error": ratio(p - o, F.abs(o)),
        "log_ratio": F.log(F.when(valid, p / F.when(valid, o))),
        "observed_intensity_class": intensity_class(o, intensity_thresholds),
        "observed_wet": F.coalesce(o >= 1.0, F.lit(False)).cast("byte"),
        "month": month,
        "year": F.year(time),
        "dayofyear": F.dayofyear(time),
        "season": season,
    }
    if include_target:
        features["error_class"] = error_class(o, p, relative_thresholds=relative_thresholds, absolute_tolerance=absolute_tolerance)
    return df.withColumns(features)


def to_ml_table(df: DataFrame, *, dropna: bool = True) -> DataFrame:
    return df.dropna() if dropna else df


def temporal_split(df: DataFrame, *, order: str = "time", train_fraction: float = 0.7, validation_fraction: float = 0.15) -> DataFrame:
    """``df`` with split: the first floor(n f) times train, then validation, then test.

    Times are numbered among the distinct ones, which are a dimension; rows join them back.
    """
    if not (0 < train_fraction < 1 and 0 <= validation_fraction < 1 and train_fraction + validation_fraction < 1):
        raise ValueError("fractions must be positive and sum to under 1")
    times = df.select(order).distinct().withColumn("__k", F.row_number().over(Window.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    first = F.floor(F.col("__n") * train_fraction)
    second = first + F.floor(F.col("__n") * validation_fraction)
    label = F.when(F.col("__n") < 3, F.raise_error(F.lit("at least three times are required"))).when(F.col("__k") < first, "train").when(F.col("__k") < second, "validation").otherwise("test")
    return df.join(times.select(order, label.alias("split")), order)


def event_group_split(df: DataFrame, *, group: str = "group", train_fraction: float = 0.7, validation_fraction: float = 0.15) -> DataFrame:
    """The same by sorted groups, so that no group is in two splits."""
    return temporal_split(df, order=group, train_fraction=train_fraction, validation_fraction=validation_fraction)


def spatial_block_split(df: DataFrame, *, lat: str = "latitude", lon: str = "longitude", lat_block: float = 2.0, lon_block: float = 2.0, test_fraction: float = 0.2, random_state: int = 0) -> DataFrame:
    """``df`` with split train or test: ceil(blocks * fraction) whole blocks at random, at least one, are held out.

    The sorted list of blocks (a dimension) is permuted on the driver.
    """
    if lat_block <= 0 or lon_block <= 0 or not 0 < test_fraction < 1:
        raise ValueError("blocks must be positive and test_fraction between 0 and 1")
    blocks = {"__a": F.floor(F.col(lat) / lat_block), "__b": F.floor(F.col(lon) / lon_block)}
    named = df.withColumns(blocks)
    every = [(r[0], r[1]) for r in named.select("__a", "__b").distinct().orderBy("__a", "__b").collect()]
    order = np.random.default_rng(random_state).permutation(len(every))
    held = [every[i] for i in order[: max(1, math.ceil(len(every) * test_fraction))]]
    table = df.sparkSession.createDataFrame(held or [(0, 0)], "__a long, __b long").withColumn("__t", F.lit(True))
    out = named.join(F.broadcast(table), ["__a", "__b"], "left")
    return out.withColumn("split", F.when(F.col("__t"), "test").otherwise("train")).drop("__a", "__b", "__t")


def validate_no_overlap(df: DataFrame, *, group: str = "group", split: str = "split") -> DataFrame:
    """``df`` itself; a group in two splits raises."""
    bad = df.groupBy(group).agg(F.count_distinct(split).alias("n")).filter("n > 1")
    if not bad.isEmpty():
        raise ValueError(f"groups in more than one split: {[r[0] for r in bad.limit(5).collect()]}")
    return df


def assign_split(df: DataFrame, splits: Mapping[str, Sequence[int]], *, position: str = "sample", default: str = "unused") -> DataFrame:
    """``df`` with split from lists of positions; a position that no row has raises."""
    rows = [(int(i), name) for name, places in splits.items() for i in places]
    table = df.sparkSession.createDataFrame(rows, f"{position} long, split string")
    if not table.join(df.select(position), position, "left_anti").isEmpty():
        raise ValueError("a split has a position out of bounds")
    return df.join(table, position, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def confusion(df: DataFrame, *, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, *, truth: str = "label", predicted: str = "predicted", probability: str | None = None) -> DataFrame:
    """One row of accuracy, balanced accuracy, F1, precision, recall, MCC and, for a binary
    probability of class 1, log loss and ROC AUC; all from the confusion counts and one ranking."""
    table = confusion(df.select(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")), truth="t", predicted="p")
    sides = table.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("s")).select("s.*")
    each = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    t, p, h = F.col("t"), F.col("p"), F.col("h")
    zero = F.lit(0.0)
    recall, precision, f1 = F.coalesce(ratio(h, t), zero), F.coalesce(ratio(h, p), zero), F.coalesce(ratio(2 * h, t + p), zero)
    n = F.sum(t)
    out = each.agg(
        ratio(F.sum(h), n).alias("accuracy"),
        F.avg(F.when(t > 0, h / t)).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
        ratio(F.sum(f1 * t), n).alias("f1_weighted"),
        F.avg(precision).alias("precision_macro"),
        F.avg(recall).alias("recall_macro"),
        F.coalesce(ratio(F.sum(h) * n - F.sum(t * p), F.sqrt(n * n - F.sum(p * p)) * F.sqrt(n * n - F.sum(t * t))), zero).alias("mcc"),
    )
    if probability is None:
        return out
    y, q = F.col(truth).cast("double"), F.col(probability)
    safe = F.greatest(F.least(q, F.lit(1 - 1e-15)), F.lit(1e-15))
    # Ranks by value: counts of each distinct probability are summed by bins.
    levels = df.groupBy(q.alias("q")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    levels = running_before(levels, "neg", "q", F.floor(F.coalesce("q", F.lit(-1.0)) * 16384).cast("long"), name="under")
    auc = levels.agg(ratio(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))
    loss = df.agg((-F.avg(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss"))
    return out.crossJoin(F.broadcast(loss)).crossJoin(F.broadcast(auc))
