import duckdb
import pytest

import __spark_entry__ as E
from oracle_check import TABLES, _digest

FAST = ["describe_numeric", "profile_columns", "missing_report", "histogram10",
        "value_counts_binned", "box_plot", "iqr_outliers", "top_n", "systematic_sample",
        "run_sql", "ts_monthly", "retention", "top_segments", "coerce_numeric_values"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["column_name", "rule", "severity", "title", "metric"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_sf0001(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf)
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _digest(sdf.columns, [tuple(r) for r in sdf.collect()])[0] == \
        _digest(ocols, rel.fetchall())[0]
