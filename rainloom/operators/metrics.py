"""Verification scores over pairs of observation and prediction.

Each score is an aggregate expression, so any number of them take one pass; ``scores`` is that
pass.  A comparison with a missing value is no event on its side, so a pair of missing values is
a correct negative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ratio


def _both(o: Column, p: Column, x: Column) -> Column:
    return F.when(o.isNotNull() & p.isNotNull(), x)


def event(value: Column, threshold: float) -> Column:
    return F.coalesce(value >= F.lit(float(threshold)), F.lit(False))


def counts(o: Column, p: Column, threshold: float = 1.0) -> dict[str, Column]:
    """hits, misses, false_alarms, correct_negatives as aggregates."""
    a, b = event(o, threshold), event(p, threshold)
    return {"hits": F.count_if(a & b), "misses": F.count_if(a & ~b), "false_alarms": F.count_if(~a & b), "correct_negatives": F.count_if(~a & ~b)}


def correlation_of(o: Column, p: Column) -> Column:
    """Pearson correlation of the valid pairs; null for a constant side."""
    x, y = _both(o, p, o), _both(o, p, p)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def expressions(o: Column, p: Column, threshold: float = 1.0) -> dict[str, Column]:
    """All simple scores by name."""
    h, m, f, c = counts(o, p, threshold).values()
    n = h + m + f + c
    by_chance = ((h + m) * (h + f) + (c + m) * (c + f)) / n
    random_hits = (h + m) * (h + f) / n
    pod, sr = ratio(h, h + m), ratio(h, h + f)
    return {
        "bias": F.avg(p - o),
        "mae": F.avg(F.abs(p - o)),
        "rmse": F.sqrt(F.avg((p - o) * (p - o))),
        "correlation": correlation_of(o, p),
        "bias_ratio": ratio(F.sum(p), F.sum(o)),
        "pod": pod,
        "far": ratio(f, h + f),
        "f1": ratio(2 * pod * sr, pod + sr),
        "heidke_skill_score": ratio(h + c - by_chance, n - by_chance),
        "threat_score": ratio(h, h + m + f),
        "equitable_threat_score": ratio(h - random_hits, h + m + f - random_hits),
        "frequency_bias": ratio(h + f, h + m),
    }


def scores(df: DataFrame, names: Sequence[str], *, observation: str = "observation", prediction: str = "prediction", threshold: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, names...) in one pass."""
    known = expressions(F.col(observation), F.col(prediction), threshold)
    return df.groupBy(*keys).agg(*[known[n].cast("double").alias(n) for n in names])


def _score(name: str, title: str):
    def one(df: DataFrame, *, keys: Sequence[str] = (), **options: object) -> DataFrame:
        return scores(df, (name,), keys=keys, **options)

    one.__name__ = one.__qualname__ = title
    one.__doc__ = f"Rows (keys, {name}) over pairs of observation and prediction."
    return one


bias, mae, rmse, correlation, bias_ratio, pod, far, f1_score, heidke_skill_score, threat_score, equitable_threat_score, frequency_bias = (
    _score(n, t) for n, t in (("bias", "bias"), ("mae", "mae"), ("rmse", "rmse"), ("correlation", "correlation"), ("bias_ratio", "bias_ratio"), ("pod", "pod"), ("far", "far"), ("f1", "f1_score"), ("heidke_skill_score", "heidke_skill_score"), ("threat_score", "threat_score"), ("equitable_threat_score", "equitable_threat_score"), ("frequency_bias", "frequency_bias"))
)


def contingency_table(df: DataFrame, *, observation: str = "observation", prediction: str = "prediction", threshold: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in counts(F.col(observation), F.col(prediction), threshold).items()])


contingency = contingency_table


def nse(df: DataFrame, *, observation: str = "observation", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Nash-Sutcliffe efficiency; the spread is over all valid observations."""
    o, p = F.col(observation), F.col(prediction)
    spread = F.count(o) * F.var_pop(o)
    return df.groupBy(*keys).agg((1 - ratio(F.sum((p - o) * (p - o)), spread)).alias("nse"))


def brier_score(df: DataFrame, *, observation: str = "observation", probability: str = "probability", keys: Sequence[str] = ()) -> DataFrame:
    """The mean squared error of a probability; one outside 0 to 1 raises at run time."""
    from ..functions.scalars import checked

    p = checked(F.col(probability), F.col(probability).between(0, 1), "probability must be between 0 and 1")
    e = p - F.col(observation)
    return df.groupBy(*keys).agg(F.avg(e * e).alias("brier_score"))


def reliability_table(df: DataFrame, *, observation: str = "observation", probability: str = "probability", bins: int = 10) -> DataFrame:
    """Rows (bin, n, mean_probability, observed_frequency) of the bins in use; the last bin is closed."""
    rows = df.filter(F.col(observation).isNotNull() & F.col(probability).isNotNull())
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(observation).alias("observed_frequency"))


def reliability_components(df: DataFrame, *, observation: str = "observation", probability: str = "probability", bins: int = 10) -> DataFrame:
    """One row (reliability, resolution, uncertainty) of the Brier score."""
    table = reliability_table(df, observation=observation, probability=probability, bins=bins)
    every = Window.partitionBy()
    n, o = F.col("n"), F.col("observed_frequency")
    table = table.withColumns({"total": F.sum("n").over(every), "base": F.sum(n * o).over(every)}).withColumn("base", F.col("base") / F.col("total"))
    return table.agg(
        F.sum(n * (F.col("mean_probability") - o) ** 2 / F.col("total")).alias("reliability"),
        F.sum(n * (o - F.col("base")) ** 2 / F.col("total")).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def fractions_skill_score(df: DataFrame, *, threshold: float = 1.0, window: int = 3, observation: str = "observation", prediction: str = "prediction", y: str = "lat_idx", x: str = "lon_idx", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, fss) from the shares of events in window x window cells, cut at the edges.

    The grid is dense within each of ``keys``: missing values are no events.  The two window sums
    are separable: along x, then along y.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be odd and positive")
    half = window // 2
    rows = df.select(*keys, y, x, event(F.col(observation), threshold).cast("double").alias("__o"), event(F.col(prediction), threshold).cast("double").alias("__p"))
    along, across = (Window.partitionBy(*keys, b).orderBy(a).rangeBetween(-half, half) for a, b in ((x, y), (y, x)))
    rows = rows.withColumns({f"__{n}x": F.sum(e).over(along) for n, e in (("o", F.col("__o")), ("p", F.col("__p")), ("n", F.lit(1.0)))})
    rows = rows.withColumns({f"__{n}": F.sum(f"__{n}x").over(across) for n in "opn"})
    fo, fp = F.col("__o") / F.col("__n"), F.col("__p") / F.col("__n")
    return rows.groupBy(*keys).agg((1 - ratio(F.avg((fp - fo) * (fp - fo)), F.avg(fp * fp) + F.avg(fo * fo))).alias("fss"))
