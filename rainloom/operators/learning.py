"""Classifiers of error classes with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tagging import classification_metrics


def make_classifier(model: str = "random_forest", *, random_state: int = 0, classes: int = 2, **options: object):
    """random_forest, gradient_boosting (one against the rest beyond two classes) or logistic."""
    kind = model.lower().replace("hist_", "")
    held = {"featuresCol": "features", "labelCol": "y", "weightCol": "w", "predictionCol": "y_hat", "rawPredictionCol": "y_raw", "probabilityCol": "y_probability"}
    if kind in ("random_forest", "rf"):
        return RandomForestClassifier(seed=random_state, **held | {"numTrees": 100, "minInstancesPerNode": 2, "maxDepth": 10} | options)
    if kind in ("gradient_boosting", "xgboost", "xgb", "gbt"):
        gbt = GBTClassifier(seed=random_state, **held | {"maxIter": 40, "stepSize": 0.1, "maxDepth": 5} | options)
        return gbt if classes <= 2 else OneVsRest(classifier=gbt, featuresCol="features", labelCol="y", weightCol="w", predictionCol="y_hat")
    if kind == "logistic":
        return LogisticRegression(**held | options)
    raise ValueError(f"unknown model {model!r}")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with w: classes weigh the same together.  Classes are few, so their counts are broadcast."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.withColumn("__t", F.sum("__c").over(Window.partitionBy())).withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy()))
    return df.join(F.broadcast(total), label).withColumn("w", F.col("__t") / (F.col("__k") * F.col("__c"))).drop("__c", "__t", "__k")


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, model: str = "random_forest", *, calibrate: bool = False, random_state: int = 0, **options: object) -> PipelineModel:
    """A fitted pipeline that adds predicted (the label); ``predict`` adds its probability.

    ``calibrate`` puts a logistic model over the scores of a two-class model on held-out rows.
    """
    classes = df.select(label).distinct().count()
    stages = [
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
        make_classifier(model, random_state=random_state, classes=classes, **options),
    ]
    rows = balanced(df, label)
    if not calibrate:
        fitted = Pipeline(stages=stages).fit(rows)
    else:
        if classes != 2:
            raise ValueError("calibration is for two classes")
        train, held = rows.randomSplit([0.67, 0.33], seed=random_state)
        base = Pipeline(stages=stages).fit(train)
        scaler = VectorAssembler(inputCols=["__score"], outputCol="__scores")
        scored = _scored(base.transform(held))
        platt = Pipeline(stages=[scaler, LogisticRegression(featuresCol="__scores", labelCol="y", predictionCol="__p", rawPredictionCol="__r", probabilityCol="calibrated")]).fit(scored)
        fitted = PipelineModel([*base.stages, *platt.stages])
    labels = fitted.stages[0].labels
    return PipelineModel([*fitted.stages, IndexToString(inputCol="y_hat", outputCol="predicted", labels=[*labels, "?"])])


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("__score", vector_to_array("y_probability")[1])


def predict(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with predicted, and positive: the (calibrated) probability of the second class."""
    kinds = [type(s).__name__ for s in fitted.stages]
    out = df
    for kind, stage in zip(kinds, fitted.stages, strict=True):
        if kind == "VectorAssembler" and stage.getOutputCol() == "__scores":
            out = _scored(out)
        out = stage.transform(out)
    source = "calibrated" if "calibrated" in out.columns else "y_probability" if "y_probability" in out.columns else None
    return out.withColumn("positive", vector_to_array(source)[1]) if source else out


def folds(df: DataFrame, n_splits: int = 5, *, strategy: str = "group", group: str | None = None, order: str | None = None, label: str | None = None) -> DataFrame:
    """``df`` with fold: groups stay whole; ``time`` folds follow the order; groups or times are a dimension."""
    if strategy == "time":
        if order is None:
            raise ValueError("time folds need an order")
        times = df.select(order).distinct().withColumn("fold", F.ntile(n_splits + 1).over(Window.orderBy(order)) - 1)
        return df.join(times, order)
    if strategy not in ("group", "stratified_group") or group is None:
        raise ValueError("strategy must be 'time', 'group' or 'stratified_group', the latter with a group")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *([F.first(label).alias("l")] if strategy == "stratified_group" and label else []))
    by = Window.partitionBy(*(["l"] if "l" in sizes.columns else [])).orderBy(F.col("n").desc(), group)
    # Groups by size are dealt forth and back, so that folds get equal shares.
    k = F.row_number().over(by) - 1
    turn, place = F.floor(k / n_splits), F.pmod(k, F.lit(n_splits))
    dealt = sizes.withColumn("fold", F.when(turn % 2 == 0, place).otherwise(n_splits - 1 - place).cast("int")).select(group, "fold")
    return df.join(dealt, group)


def cross_validate_classifier(df: DataFrame, features: Sequence[str], label: str, *, strategy: str = "group", group: str | None = None, order: str | None = None, n_splits: int = 5, model: str = "random_forest", random_state: int = 0, **options: object) -> DataFrame:
    """Rows (fold, scores...): each fold is predicted by a model of the others, for ``time`` of the earlier ones."""
    dealt = folds(df, n_splits, strategy=strategy, group=group, order=order, label=label).persist()
    out = None
    for k in range(1, n_splits + 1) if strategy == "time" else range(n_splits):
        train = dealt.filter(F.col("fold") < k if strategy == "time" else F.col("fold") != k)
        fitted = fit_classifier(train, features, label, model, random_state=random_state, **options)
        scores = classification_metrics(predict(fitted, dealt.filter(F.col("fold") == k)), truth=label).withColumn("fold", F.lit(k))
        out = scores if out is None else out.unionByName(scores)
    return out


def permutation_importance(fitted: PipelineModel, df: DataFrame, features: Sequence[str], label: str, *, n_repeats: int = 10, metric: str = "balanced_accuracy", random_state: int = 0) -> DataFrame:
    """Rows (feature, importance_mean, importance_std): the fall of the metric when a column is shuffled."""
    spark = df.sparkSession
    base = classification_metrics(predict(fitted, df), truth=label).first()[metric]
    # Values are exchanged among the rows of a partition, which are a random part of all rows.
    place = ["__part", "__k"]
    part = df.select(*features, label).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("__part", F.spark_partition_id()).persist()
    numbered = part.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*features))).persist()
    rows = []
    for f in features:
        for r in range(n_repeats):
            turn = Window.partitionBy("__part").orderBy(F.rand(random_state + 1000 * r))
            other = numbered.select("__part", F.col(f).alias("__v"), F.row_number().over(turn).alias("__k"))
            shuffled = numbered.drop(f).join(other, place).withColumnRenamed("__v", f)
            rows.append((f, base - classification_metrics(predict(fitted, shuffled), truth=label).first()[metric]))
    return spark.createDataFrame(rows, "feature string, drop double").groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
