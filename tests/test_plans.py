"""Physical-plan checks: pruning, pushdown, join shapes, no pair-generating joins."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["iqr_outliers", "top_n", "run_sql", "top_segments",
                                  "histogram10", "retention", "value_counts",
                                  "profile_columns", "coerce_numeric_values", "ts_monthly"])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(E.queries()["iqr_outliers"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
    plan = _plan(E.queries()["run_sql"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan


def test_top_k_is_bounded_per_task(spark):
    for name in ("top_n", "preview", "value_counts"):
        assert "TakeOrderedAndProject" in _plan(E.queries()[name](spark, SF))


def test_hot_value_holding_a_third_of_rows(spark):
    from tablescope import api
    n = 3000
    df = spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7.0 ELSE CAST(id AS DOUBLE) END AS v",
        "CASE WHEN id % 3 = 0 THEN 0.0 ELSE CAST(id % 97 AS DOUBLE) / 10 END AS w")
    import numpy as np
    vals = np.array([7.0 if i % 3 == 0 else float(i) for i in range(n)])
    s = api.column_summary(df, ["v"], {"q1": .25, "m": .5}).first()
    assert s["q1"] == pytest.approx(np.quantile(vals, .25))
    assert s["m"] == pytest.approx(np.quantile(vals, .5))
    assert api.mode_by_column(df, ["v"]).first()["mode"] == 7.0
    qq = api.qq_points(df, ["v"]).orderBy("i").collect()
    assert [r["i"] for r in qq] == list(range(1, n + 1))
    assert [r["sample"] for r in qq] == sorted(vals.tolist())
    counts = {r["value"]: r["count"] for r in api.value_counts(df, "v").collect()}
    assert counts[7.0] == n // 3 + 1          # plus the row id = 7
    # a third of all points in one grid cell: all core, counted without pairs
    res = api.dbscan(df, ["w", "v"], eps=0.05, min_samples=5, id_cols=["id"])
    sizes = {r["cluster"]: r["size"] for r in api.cluster_sizes(res.assignments).collect()}
    assert max(sizes.values()) >= n // 3
