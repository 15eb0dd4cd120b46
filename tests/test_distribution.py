import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import statistics

from tablescope import api


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=80))
def test_histogram_matches_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r["count"] for r in api.histogram(df, ["v"], 10).orderBy("bin").collect()]
    exp, _ = np.histogram(np.array(xs), bins=10)
    assert got == exp.tolist()


def test_cut_bins_match_pandas(spark):
    rng = np.random.default_rng(7)
    for _ in range(5):
        xs = rng.normal(size=200).round(3)
        df = spark.createDataFrame([(float(x),) for x in xs], "v double")
        got = api.value_counts_binned(df, "v").orderBy("bin").collect()
        exp = pd.cut(pd.Series(xs), bins=10).value_counts().sort_index()
        assert [r["count"] for r in got] == exp.tolist()
        # pandas stores interval edges rounded to 3 decimals (precision=3)
        assert got[0]["lower"] == pytest.approx(exp.index[0].left, abs=1e-3)
    df = spark.createDataFrame([(float(x),) for x in range(21)], "v double")
    got = api.value_counts_binned(df, "v").orderBy("bin").collect()
    assert [r["count"] for r in got] == [3, 2, 2, 2, 2, 2, 2, 2, 2, 2]
    assert got[0]["lower"] == pytest.approx(-0.02)


def test_outliers_partition_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = api.iqr_outliers(df, ["value"], ids=["event_id"]).count()
    f = api.fences(df, ["value"]).first()
    inl = df.where((df.value >= f["lower"]) & (df.value <= f["upper"])).count()
    assert out + inl == df.where(df.value.isNotNull()).count()


def test_shapiro_wilk_published_value(spark):
    xs = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    r = api.shapiro_wilk(df).first()
    assert r["W"] == pytest.approx(0.78881, abs=1e-5)
    assert r["p_value"] == pytest.approx(0.00670, abs=1e-5)
    assert r["interpretation"] == "Non-normal distribution"


def test_shapiro_large_n_is_null(spark):
    df = spark.range(6000).selectExpr("cast(id as double) as v")
    r = api.shapiro_wilk(df).first()
    assert r["p_value"] is None and r["interpretation"] == "Not tested"


def test_qq_points_filliben(spark):
    xs = [3.0, 1.0, 2.0, 5.0, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    pts = api.qq_points(df).orderBy("i").collect()
    n = len(xs)
    m = [1 - 0.5 ** (1 / n)] + [(i - 0.3175) / (n + 0.365) for i in range(2, n)] + [0.5 ** (1 / n)]
    nd = statistics.NormalDist()
    assert [r["sample"] for r in pts] == sorted(xs)
    for r, mm in zip(pts, m):
        assert r["theoretical"] == pytest.approx(nd.inv_cdf(mm), abs=1e-12)


def test_systematic_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    s = api.systematic_sample(df, "o_totalprice", ["o_orderkey"]).orderBy("idx").collect()
    n = df.count()
    step = n // 100
    assert [r["idx"] for r in s] == [i * step for i in range(100)]
    small = df.orderBy("o_orderkey").limit(7)
    assert api.systematic_sample(small, "o_totalprice", ["o_orderkey"]).count() == 7
    assert s[0]["label"].startswith("Row 0: o_totalprice = ")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e4, 1e4, allow_nan=False).map(lambda x: round(x, 2)),
                min_size=16, max_size=80, unique=True))
def test_cut_bins_match_pandas_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r["count"] for r in api.value_counts_binned(df, "v").orderBy("bin").collect()]
    exp = pd.cut(pd.Series(xs), bins=10).value_counts().sort_index().tolist()
    assert got == exp
