from tablescope import api


def test_ask_rules(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = api.ask(df, "top 10 by o_totalprice", ["o_orderkey"])
    assert a.kind == "top" and a.frame.count() == 10
    assert "o_totalprice" in a.message
    top = [r["o_totalprice"] for r in a.frame.collect()]
    assert top == sorted(top, reverse=True)
    b = api.ask(df, "summary of o_custkey")          # 'sum' hits as a substring
    assert b.kind == "stats" and [r["column_name"] for r in b.frame.collect()] == ["o_custkey"]
    c = api.ask(df, "top orders in 2020")            # no "top N" -> falls through
    assert c.kind == "preview" and c.frame.count() == 10
    d = api.ask(df, "average of o_orderstatus")      # non-numeric target -> no row
    assert d.kind == "stats" and d.frame.count() == 0


def test_quick_insights_lines(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    lines = {(r["section"], r["seq"]): r["text"] for r in api.quick_insights(df, "why").collect()}
    assert lines[("insight", 0)] == "The dataset contains 1000 rows and 6 columns."
    assert lines[("insight", 2)] == "Numeric columns: event_id, user_id, value."
    assert ("recommendation", 3) in lines


def test_statistical_insight_rules(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    rules = {(r["column_name"], r["title"]) for r in api.statistical_insights(df).collect()}
    assert ("value", "Non-Normal Distribution") in rules
    assert ("value", "Outliers Detected") in rules
    assert ("value", "Transformation Suggestion") in rules


def test_analyze_dispatch(spark):
    import pytest
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    res = api.analyze(df, "statistical")
    assert res["column"] == "o_orderkey" and "o_totalprice" in res["other_numeric_columns"]
    assert res["basic_stats"].count() == 1
    custom = api.analyze(df, "custom", order_by=["o_orderkey"])
    assert custom["sample"].count() == 5
    ts = api.analyze(df, "time_series", ts="o_orderdate", value="o_totalprice")
    assert ts["forecast"].count() == 3
    with pytest.raises(ValueError):
        api.analyze(df, "nope")
    with pytest.raises(ValueError, match="not numeric"):
        api.describe_numeric(df, ["o_orderstatus"])
    with pytest.raises(ValueError, match="not found"):
        api.describe_numeric(df, ["zzz"])
