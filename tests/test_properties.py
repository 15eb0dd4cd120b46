"""Property tests: layout independence and brute-force equality."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brute import dbscan_reference, scale
from tablescope import api


def _rows(df, *order):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                  for r in df.collect())


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    shuffled = df.repartition(7, "user_id")
    for op in (lambda d: api.describe_numeric(d),
               lambda d: api.histogram(d, ["value"], 10),
               lambda d: api.value_counts_binned(d, "value"),
               lambda d: api.mode_by_column(d),
               lambda d: api.iqr_outliers(d, ["value"], ids=["event_id"]),
               lambda d: api.statistical_insights(d).drop("message"),
               lambda d: api.systematic_sample(d, "value", ["event_id"])):
        assert _rows(op(df)) == _rows(op(shuffled))


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.integers(0, 10_000), st.sampled_from([0.15, 0.3, 0.6]), st.sampled_from([3, 5, 8]))
def test_dbscan_random_layouts(spark, seed, eps, ms):
    rng = np.random.default_rng(seed)
    centers = rng.normal(scale=3, size=(3, 2))
    pts = np.vstack([c + rng.normal(scale=0.4, size=(40, 2)) for c in centers]
                    + [rng.uniform(-8, 8, size=(20, 2))]).round(3)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                               "id long, x double, y double")
    got = [r["cluster"] for r in api.dbscan(df, ["x", "y"], eps, ms, id_cols=["id"])
           .assignments.orderBy("id").collect()]
    assert got == dbscan_reference(scale(pts), eps, ms)
