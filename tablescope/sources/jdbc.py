"""Database tables over JDBC (MySQL, PostgreSQL, any JDBC URL).

Large tables are split with ``partitionColumn``/``numPartitions`` so that
executors read ranges in parallel; ``limit`` is pushed to the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# How each dialect lists its tables (the reference's queries).
LIST_TABLES_SQL = {
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "postgresql": ("SELECT table_name FROM information_schema.tables "
                   "WHERE table_schema = 'public'"),
    "derby": "SELECT TABLENAME AS table_name FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'",
}


def jdbc_url(kind: str, host: str, port: int | None, database: str) -> str:
    """URL for the reference's source kinds (Supabase is PostgreSQL)."""
    kind = "postgresql" if kind in ("postgres", "postgresql", "supabase") else kind
    default = {"mysql": 3306, "postgresql": 5432}[kind]
    return f"jdbc:{kind}://{host}:{port or default}/{database}"


def _reader(spark: SparkSession, url: str, user: str | None, password: str | None,
            driver: str | None):
    r = spark.read.format("jdbc").option("url", url)
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    if driver:
        r = r.option("driver", driver)
    return r


def jdbc_table(spark: SparkSession, url: str, table: str, user: str | None = None,
               password: str | None = None, driver: str | None = None,
               partition_column: str | None = None, lower: int | None = None,
               upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """A database table as a DataFrame, range-partitioned when asked.

    Bounds that are not given are asked from the database; the number of ranges
    defaults to the cluster's parallelism.
    """
    r = _reader(spark, url, user, password, driver).option("dbtable", table)
    if partition_column:
        if lower is None or upper is None:
            lo, hi = jdbc_query(spark, url, f"SELECT MIN({partition_column}) AS lo, "
                                f"MAX({partition_column}) AS hi FROM {table}", user, password,
                                driver).first()
            lower, upper = lo if lower is None else lower, hi if upper is None else upper
        if lower is not None:  # an empty table has no bounds
            r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
                 .option("upperBound", upper)
                 .option("numPartitions", num_partitions or spark.sparkContext.defaultParallelism))
    return r.load()


def jdbc_preview(spark: SparkSession, url: str, table: str, n: int = 10, **kw) -> DataFrame:
    """First ``n`` rows (the limit is pushed down to the database)."""
    return jdbc_table(spark, url, table, **kw).limit(n)


def jdbc_query(spark: SparkSession, url: str, sql: str, user: str | None = None,
               password: str | None = None, driver: str | None = None) -> DataFrame:
    """S9 for databases: run SQL in the source database."""
    return _reader(spark, url, user, password, driver).option("query", sql).load()


def jdbc_tables(spark: SparkSession, url: str, dialect: str, **kw) -> DataFrame:
    """Table names of a database (one column ``table_name``)."""
    return jdbc_query(spark, url, LIST_TABLES_SQL[dialect], **kw)


def jdbc_tables_preview(spark: SparkSession, url: str, dialect: str, n: int = 10, **kw
                        ) -> tuple[DataFrame, DataFrame | None]:
    """The table names, and a preview of the first one (None without tables)."""
    names = jdbc_tables(spark, url, dialect, **kw)
    first = names.orderBy("table_name").first() if "table_name" in names.columns else \
        names.orderBy(names.columns[0]).first()
    return names, jdbc_preview(spark, url, first[0], n, **kw) if first else None
