import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom import model
from rainloom.functions import scalars, units
from rainloom.operators import climatology, drought, extremes, metrics, spatial, tagging, timeaxis, trends
from rainloom.operators import verification as V
from rainloom.sources import normalize, readers


def frame(spark, values, start=dt.datetime(2000, 1, 1), step=None, monthly=False):
    if monthly:
        rows = [(dt.datetime(start.year + (start.month - 1 + k) // 12, (start.month - 1 + k) % 12 + 1, 1), v) for k, v in enumerate(values)]
    else:
        rows = [(start + k * (step or dt.timedelta(days=1)), v) for k, v in enumerate(values)]
    return spark.createDataFrame([(t, None if v is None else float(v)) for t, v in rows], "time timestamp_ntz, value double")


def pairs(spark, o, p):
    return spark.createDataFrame([(k, None if a is None else float(a), None if b is None else float(b)) for k, (a, b) in enumerate(zip(o, p, strict=True))], "pos long, observation double, prediction double")


def test_nan_never_leaves(spark):
    df = model.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "value double"))
    assert sorted(r.value is None for r in df.collect()) == [False, True]


def test_climatology_and_anomaly(spark):
    df = frame(spark, range(24), monthly=True)
    means = {r.month: r.climatology for r in climatology.climatology(df).collect()}
    assert means[1] == 6 and means[12] == 17
    assert [r.anomaly for r in climatology.anomaly(df).orderBy("time").collect()] == [-6.0] * 12 + [6.0] * 12


def test_calendar_lengths(spark):
    df = spark.createDataFrame([(2000,), (2001,), (1900,)], "y int")
    get = lambda name: [r[0] for r in df.orderBy("y").select(timeaxis.expected_days_in_year(F.col("y"), name)).collect()]
    assert get("standard") == [365, 366, 365] and get("julian") == [366, 366, 365]
    assert get("noleap") == [365] * 3 and get("360_day") == [360] * 3 and get("366_day") == [366] * 3
    with pytest.raises(ValueError):
        timeaxis.expected_days_in_year(F.col("y"), "lunar")


def test_time_axis(spark):
    df = frame(spark, [1, 1, 1, 1], start=dt.datetime(2000, 2, 27))
    assert [r.time.day for r in timeaxis.drop_leap_day(df).orderBy("time").collect()] == [27, 28, 1]
    assert timeaxis.infer_frequency(frame(spark, [1] * 24, step=dt.timedelta(hours=1))) == "hourly"
    assert timeaxis.infer_frequency(frame(spark, [1] * 6, monthly=True)) == "monthly"
    years = timeaxis.season_year(frame(spark, [1] * 4, start=dt.datetime(2000, 12, 30))).collect()
    assert {r.season_year for r in years} == {2001}
    with pytest.raises(ValueError):
        timeaxis.validate_time(df.unionByName(df))
    full = frame(spark, [1.0] * 366)
    assert timeaxis.year_complete_mask(full).first().complete and not timeaxis.year_complete_mask(full.limit(300)).first().complete


def test_seasonal_series(spark):
    df = frame(spark, [1.0] * 1096).withMetadata("value", {"standard_name": "precipitation"})
    out = {r.season_year: r.value for r in climatology.seasonal_series(df, "JJA", frequency="daily").collect()}
    assert out == {2000: 92, 2001: 92, 2002: 92}
    short = df.filter("NOT (year(time) = 2001 AND month(time) = 7 AND day(time) = 15)")
    assert {r.season_year: r.value for r in climatology.seasonal_series(short, "JJA", frequency="daily").collect()}[2001] is None
    djf = climatology.seasonal_series(frame(spark, range(27), start=dt.datetime(1999, 12, 1), monthly=True), "DJF", aggregation="mean", frequency="monthly")
    assert sorted(r.season_year for r in djf.collect()) == [2000, 2001, 2002]


def test_metrics(spark):
    df = pairs(spark, [1, 2, 3, 4], [2, 2, 4, 3])
    row = metrics.scores(df, ("bias", "mae", "rmse", "correlation")).first()
    assert tuple(row) == pytest.approx((0.25, 0.75, math.sqrt(0.75), 0.674199862463242))
    assert metrics.nse(df).first().nse == pytest.approx(0.4)
    assert metrics.f1_score(pairs(spark, [0, 1, 1, 0], [0, 1, 0, 1]), threshold=0.5).first().f1 == 0.5
    perfect = metrics.scores(pairs(spark, [0, 2, 0, 5], [0, 2, 0, 5]), ("threat_score", "equitable_threat_score", "frequency_bias")).first()
    assert tuple(perfect) == (1, 1, 1)
    assert metrics.bias_ratio(pairs(spark, [0, 1, 2], [0, 2, 4])).first().bias_ratio == 2
    table = metrics.contingency_table(pairs(spark, [None, 2], [None, 2])).first()
    assert (table.hits, table.correct_negatives) == (1, 1)
    constant = metrics.correlation(pairs(spark, [1, 1], [1, 2])).first()
    assert constant.correlation is None


def test_probabilistic_and_fss(spark):
    p = spark.createDataFrame([(0.0, 0.1), (1.0, 0.9), (1.0, 0.9), (0.0, 0.1)], "observation double, probability double")
    assert metrics.reliability_components(p, bins=2).first().reliability == pytest.approx(0.01)
    b = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 0.5)], "observation double, probability double")
    assert metrics.brier_score(b).first()[0] == pytest.approx(1 / 12)
    g = spark.createDataFrame([(i, j, 1.0, 1.0) for i in range(3) for j in range(3)], "lat_idx int, lon_idx int, observation double, prediction double")
    assert metrics.fractions_skill_score(g).first().fss == 1


def test_fdr(spark):
    df = spark.createDataFrame([(1, 0.001), (2, 0.01), (3, 0.2), (4, 0.8), (5, None)], "cell long, pvalue double")
    assert [r.significant_fdr for r in trends.fdr_mask(df).orderBy("cell").collect()] == [True, True, False, False, False]


def test_trends(spark):
    df = frame(spark, range(10))
    assert trends.sens_slope(df).first().slope == 1
    assert trends.mann_kendall(df).first().tau == 1
    field = spark.createDataFrame([(k, lat, lon, float(k)) for k in range(16) for lat in (10.0, 20.0) for lon in (1.0, 2.0)], "time long, latitude double, longitude double, value double")
    row = trends.regional_trend(field).first()
    assert row.slope > 0 and row.pvalue < 0.05
    out = trends.field_significance(field, n_resamples=25, block_length=3).first()
    assert (out.observed_count, out.n_cells) == (4, 4) and out.field_pvalue < 0.05
    again = trends.field_significance(field.repartition(7), n_resamples=25, block_length=3).first()
    assert out == again


def test_extremes(spark):
    df = frame(spark, [0, 2, 3, 8, 1, 12, 2, 7, 15, 4])
    assert [r.excess for r in extremes.pot_exceedances(df, 5.0).orderBy("time").collect()] == [3, 7, 2, 10]
    peaks = extremes.decluster_exceedances(frame(spark, [0, 8, 12, 2, 1, 9, 7, 0, 11, 0]), 5.0, 2).orderBy("time").collect()
    assert [r.value for r in peaks] == [12, 11]
    assert scalars.return_level(100, 0.2, 30, 0.01, 200) == pytest.approx(100 + 150 * (2**0.2 - 1))
    with pytest.raises(ValueError):
        scalars.return_level(20, 0.1, 10, 0.05, 10)
    table = extremes.threshold_diagnostics(df, [5.0]).first()
    assert table.n_exceedances == 4 and table["shape"] is None
    page = extremes.pot_diagnostic_report(extremes.threshold_counts(df, [5.0]))
    assert page.startswith("<!DOCTYPE html>") and "n_exceedances" in page


def test_drought(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([-2.2, -1.7, -1.2, 0.0, 1.2, 1.7, 2.2])], "k long, z double")
    got = [r[0] for r in df.orderBy("k").select(scalars.drought_category(F.col("z"))).collect()]
    assert got == ["extreme drought", "severe drought", "moderate drought", "near normal", "moderately wet", "severely wet", "extremely wet"]
    months = frame(spark, [v for _ in range(12) for v in range(1, 41)], start=dt.datetime(1960, 1, 1), monthly=True)
    z = [r.spi for r in drought.spi(months).collect()]
    assert any(v is not None for v in z) and all(v is None or abs(v) <= 8 for v in z)
    with pytest.raises(ValueError):
        drought.spi(months, 0)


def test_errors_and_splits(spark):
    df = pairs(spark, [0, 10, 10, 10], [0, 2, 7, 20])
    got = [r[0] for r in df.orderBy("pos").select(scalars.error_class(F.col("observation"), F.col("prediction"))).collect()]
    assert got == ["near_zero", "underestimate_severe", "underestimate_moderate", "overestimate_severe"]
    rows = spark.createDataFrame([(k, k // 2) for k in range(20)], "time long, group long")
    split = {r.time: r.split for r in tagging.temporal_split(rows, train_fraction=0.6, validation_fraction=0.2).collect()}
    assert [list(split.values()).count(s) for s in ("train", "validation", "test")] == [12, 4, 4] and split[0] == "train" and split[19] == "test"
    grouped = tagging.event_group_split(rows, train_fraction=0.6, validation_fraction=0.2)
    tagging.validate_no_overlap(grouped)
    with pytest.raises(ValueError):
        tagging.validate_no_overlap(grouped.unionByName(grouped.withColumn("split", F.lit("x"))))
    cells = spark.createDataFrame([(a, 1.0) for a in (0.1, 0.2, 0.3, 2.1, 2.2, 2.3)], "latitude double, longitude double")
    held = tagging.spatial_block_split(cells, test_fraction=0.5).filter("split = 'test'").collect()
    assert len(held) == 3 and len({int(r.latitude // 2) for r in held}) == 1


def test_scorecard_ranking_and_experiment(spark):
    rows = [(dt.datetime(2000, 6, 1) + dt.timedelta(days=k), 1.0, 1.0, float(v)) for k, v in enumerate([0, 2, 0, 5, 10, 20])]
    ref = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, value double")
    config = V.ExperimentConfig(reference=ref, products={"same": ref, "low": ref.withColumn("value", F.col("value") * 0.8)}, seasons={"JJAS": (6, 7, 8, 9)}, uncertainty_resamples=20, block_length=2)
    out = V.run_experiment(config)
    assert [(r.dataset, r["rank"]) for r in out.ranking.collect()] == [("same", 1), ("low", 2)]
    assert out.overall.count() == 2 and {r.period for r in out.seasonal.collect()} == {"JJAS"}
    first = sorted(out.uncertainty.collect())
    assert first and first == sorted(V.run_experiment(config).uncertainty.collect())
    assert {"lower_95", "median", "upper_95"} <= set(out.uncertainty.columns)


def test_save(spark, tmp_path):
    ref = spark.createDataFrame([(dt.datetime(2000, 6, k), 1.0, 1.0, float(k)) for k in range(1, 5)], "time timestamp_ntz, latitude double, longitude double, value double")
    paths = V.save_experiment(V.run_experiment(V.ExperimentConfig(reference=ref, products={"a": ref})), str(tmp_path))
    assert spark.read.option("header", True).csv(paths["overall"]).count() == 1 and spark.read.parquet(paths["spatial"]).count() == 1


def test_units(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1000.0)], "precipitation double, temperature double, surface_pressure double")
    df = df.withMetadata("precipitation", {"units": "m"}).withMetadata("temperature", {"units": "degC"}).withMetadata("surface_pressure", {"units": "hPa"})
    out = units.normalize_units(df)
    assert tuple(out.first()) == pytest.approx((1000.0, 273.15, 100000.0))
    assert out.schema["temperature"].metadata["units"] == "K"
    with pytest.raises(ValueError):
        units.convert_units(df, "precipitation", "K")
    with pytest.raises(KeyError):
        units.to_si(df, "precipitation", "colour")


def test_space(spark):
    g = spark.createDataFrame([("t", 0.0, 0.0, 0.0), ("t", 0.0, 1.0, 1.0), ("t", 1.0, 0.0, 1.0), ("t", 1.0, 1.0, 2.0)], "time string, latitude double, longitude double, value double")
    at = spark.createDataFrame([(0.5, 0.5), (9.0, 9.0)], "latitude double, longitude double")
    out = spatial.regrid(g, at).collect()
    assert len(out) == 1 and out[0].value == pytest.approx(1.0)
    assert spatial.regrid(g, at.limit(1), method="conservative").first().value == pytest.approx(1.0, abs=1e-3)
    lon = spark.createDataFrame([(0.0,), (180.0,), (270.0,)], "longitude double")
    assert spatial.normalize_longitude(lon).agg(F.max("longitude")).first()[0] == 180
    w = [r.weight for r in spatial.cosine_latitude_weights(spark.createDataFrame([(60.0,), (-60.0,), (0.0,)], "latitude double")).collect()]
    assert sum(w) / 3 == pytest.approx(1)
    assert scalars.nested_grid_spacing(9000, [3, 3]) == [9000, 3000, 1000]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("2000-01-01", 20.0, 85.0, 4.0)], "Date string, LAT double, LON double, rainfall double")
    assert normalize.normalize_stations(df).columns == ["time", "latitude", "longitude", "precipitation"]
    wrf = spark.createDataFrame([("2000-01-01_06:00:00", 1.0, 1.0, 2.0, 3.0)], "Times string, XLAT double, XLONG double, RAINC double, RAINNC double")
    with pytest.warns(UserWarning):
        out = normalize.normalize_dataset(wrf, dataset="wrf")
    assert {"time", "latitude", "longitude", "RAINC"} <= set(out.columns) and out.first().time == dt.datetime(2000, 1, 1, 6)
    with pytest.raises(ValueError):
        normalize.normalize_coords(df.drop("LAT"), strict=True)
    df.write.parquet(str(tmp_path / "x.parquet"))
    assert readers.open_dataset(spark, str(tmp_path / "x.parquet")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.validate_input_paths(spark, a=str(tmp_path / "missing"))
    era = spark.createDataFrame([(dt.datetime(2000, 1, k), 1.0, 1.0, 0.001 * k) for k in (1, 2, 3)], "time timestamp_ntz, latitude double, longitude double, tp double").withMetadata("tp", {"units": "m"})
    assert [r.value for r in readers.load_precipitation(era, family="era5").orderBy("time").collect()] == pytest.approx([1, 2, 3])


def test_streaming(spark, tmp_path):
    from rainloom.streaming.precipitation import streaming_daily_amount

    frame(spark, [1.0] * 49, step=dt.timedelta(hours=1)).withColumn("time", F.col("time").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time timestamp, value double").parquet(str(tmp_path / "in"))
    q = streaming_daily_amount(stream, delay="1 hour").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select * from days").collect()) == [1, 24, 24]


def test_names_are_resolved_by_the_strongest_claim(spark):
    plan = normalize.resolve(["Lat", "lat", "tp", "pr", "precip"], {"latitude": normalize.COORDINATES["latitude"], "precipitation": normalize.VARIABLES["precipitation"]}, product="cmip6")
    assert plan.renames() == {"lat": "latitude", "pr": "precipitation"}
    assert plan.taken["precipitation"].reason is normalize.Reason.PRESET
    given = normalize.resolve(["tp", "pr"], {"precipitation": normalize.VARIABLES["precipitation"]}, given={"precipitation": "tp"}, product="cmip6")
    assert given.renames() == {"tp": "precipitation"} and given.taken["precipitation"].reason is normalize.Reason.GIVEN
    assert normalize.resolve(["LAT"], normalize.COORDINATES).renames() == {"LAT": "latitude"}
    both = normalize.resolve(["RAINC", "RAINNC"], normalize.VARIABLES, product="wrf")
    assert both.totals == ("precipitation",) and both.renames() == {}
    df = spark.createDataFrame([(1.0, 2.0)], "lat double, other double")
    with pytest.raises(KeyError):
        normalize.standardize_variables(df, variables={"temperature": "missing"}, strict=True)
    assert normalize.find_variable(df, "temperature") is None and normalize.find_name(["LAT"], ["lat"]) == "LAT"


def test_fdr_mask_equals_the_step_up_rule(spark):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.random(200), rng.random(60) * 0.01, [0.0, 0.0, 1.0]]), 3)
    rows = [(int(k % 3), float(x)) for k, x in enumerate(p)] + [(0, None), (None, 0.001), (None, 0.9)]
    got = trends.fdr_mask(spark.createDataFrame(rows, "g int, pvalue double"), 0.1, within=["g"]).collect()
    for g in (0, 1, 2, None):
        own = np.sort([x for a, x in rows if a == g and x is not None])
        holds = own <= 0.1 * np.arange(1, len(own) + 1) / len(own)
        limit = own[holds].max() if holds.any() else -1
        assert all(r.significant_fdr == (r.pvalue is not None and r.pvalue <= limit) for r in got if r.g == g)
    assert len(got) == len(rows)


def test_nonstationary_ci_draws_one_stream_in_many_partitions(spark):
    from rainloom.functions import kernels as K

    rng = np.random.default_rng(8)
    rows = [(k, t, float(y), float(t % 12)) for k in ("a", "b") for t, y in enumerate(rng.exponential(10, 40))]
    df = spark.createDataFrame(rows, "k string, time long, excess double, covariate double")
    got = {r.k: r for r in extremes.gpd_nonstationary_ci(df, keys=["k"], n_resamples=120).collect()}
    for k in "ab":
        y, z, _, _ = K.clean_pair([r[2] for r in rows if r[0] == k], [r[3] for r in rows if r[0] == k])
        p, _ = K.gpd_fit_covariate(y, z)
        draws = np.random.default_rng(0).random((120, 40))
        fits = np.array([K.gpd_fit_covariate(K.gpd_ppf(p[0], 1.0, u) * np.exp(p[1] + p[2] * z), z)[0] for u in draws])
        bounds = np.quantile(fits, [0.025, 0.975], axis=0).T.ravel()
        assert list(got[k])[1:] == pytest.approx([*p, *bounds, 40], rel=1e-12)
    alone = extremes.gpd_nonstationary_ci(df.filter("k = 'a'"), n_resamples=120).first()
    assert list(alone) == list(got["a"])[1:]
    work = []
    real = extremes.per_series
    extremes.per_series = lambda rows, keys, *a: work.append((list(keys), rows.rdd.getNumPartitions())) or real(rows, keys, *a)
    try:
        extremes.gpd_nonstationary_ci(df, keys=["k"], n_resamples=120)
    finally:
        extremes.per_series = real
    assert work[0] == (["k", "__first"], extremes.PARTITIONS)
