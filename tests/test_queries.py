"""Every registered climate query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from rainloom.plans import queries

DATA = "/root/testdata/sf0.001"
SLOW = {"cross_validate_classifier", "permutation_importance", "gpd_nonstationary_ci", "gpd_model_comparison_bootstrap", "gev_return_level_ci", "pot_threshold_bootstrap", "pot_return_level_ci", "gpd_fit_nonstationary", "gpd_model_comparison"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, table):
    order = sorted(columns)
    plain = lambda x: round(float(x), 5) + 0.0 if isinstance(x, float) else str(x)[:19] if hasattr(x, "isoformat") else x
    return sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows(df.columns, map(tuple, df.collect()))
    assert all(x == x for r in got for x in r), "NaN"
    if name in queries.SQL:
        out = duck.sql(queries.SQL[name])
        assert got == rows(out.columns, out.fetchall())


BOOTSTRAPS = {"field_significance": "trends", "sens_slope_ci": "trends", "regional_slope_ci": "trends", "bootstrap_uncertainty": "V"} | {n: "extremes" for n in ("gev_return_level_ci", "gpd_goodness_of_fit_bootstrap", "gpd_model_comparison_bootstrap", "gpd_nonstationary_ci", "pot_threshold_bootstrap", "pot_return_level_ci")}


@pytest.mark.parametrize("name", sorted(BOOTSTRAPS))
def test_bootstraps_have_the_default_resamples(spark, monkeypatch, name):
    def seen(*args, **options):
        raise KeyError(*[k for k in options if "resamples" in k])

    monkeypatch.setattr(getattr(queries, BOOTSTRAPS[name]), name, seen)
    with pytest.raises(KeyError) as found:
        queries.QUERIES["experiment_uncertainty" if name == "bootstrap_uncertainty" else name](spark, DATA)
    assert not found.value.args
