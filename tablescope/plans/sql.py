"""Run SQL over registered tables (Catalyst plans it; nothing hand-written)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None
            ) -> DataFrame:
    """Register ``views`` as temporary views and run ``sql``."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
