"""

Every query reads whole test tables (or data Spark derives from them) and runs
the library operator on them.  Computed doubles are rounded on both sides
(4 decimals; sums of money 2) so that summation-order noise does not change
the hash; display-only text columns are left out of the compared output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import api

SMOKE_DIR = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round(df: DataFrame, digits: int = 4, overrides: dict[str, int] | None = None
           ) -> DataFrame:
    overrides = overrides or {}
    # "+ 0.0" turns a rounded -0.0 into 0.0 (IEEE), so the sign of a zero never
    # depends on summation order.
    return df.withColumns({
        f.name: F.round(F.col(f"`{f.name}`"), overrides.get(f.name, digits)) + F.lit(0.0)
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def _docs_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")


def _events_text(spark: SparkSession, sf: str) -> DataFrame:
    """events with two text columns (F4): a JSON-extracted number and a mixed one."""
    ev = _t(spark, sf, "events")
    return ev.select(
        "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").alias("props_num"),
        F.when(F.col("event_id") % 5 == 0, F.lit("x"))
        .otherwise(F.col("value").cast("string")).alias("amount_txt"))


LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NUM = ["event_id", "user_id", "value"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


# ---------------------------------------------------------------------------
# queries

def q_describe_numeric(spark, sf):
    return _round(api.describe_numeric(_t(spark, sf, "lineitem")))


def q_basic_stats(spark, sf):
    df = api.basic_stats(_t(spark, sf, "orders"))
    return _round(df.select(*[c for c in df.columns if not c.endswith("_text")]))


def q_profile_columns(spark, sf):
    return api.profile_columns(_docs_labels(spark, sf))


def q_profile_pages(spark, sf):
    return api.profile_columns(_t(spark, sf, "pages"))


def q_profile_conversations(spark, sf):
    return api.profile_columns(_t(spark, sf, "conversations"))


def q_profile_embeddings(spark, sf):
    return api.profile_columns(_t(spark, sf, "embeddings"))


def q_value_counts_text(spark, sf):
    return api.value_counts(_t(spark, sf, "conversations"), "role").drop("label")


def q_missing_report(spark, sf):
    return _round(api.missing_report(_docs_labels(spark, sf)))


def q_skewness_by_column(spark, sf):
    return _round(api.skewness_by_column(_t(spark, sf, "events")))


def q_kurtosis_by_column(spark, sf):
    return _round(api.kurtosis_by_column(_t(spark, sf, "events")))


def q_mode_by_column(spark, sf):
    return _round(api.mode_by_column(_t(spark, sf, "lineitem")).drop("mode_text"))


def _big_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids beyond 2^53, where neighbours are one double; and one that repeats."""
    base = F.lit(9007199254740992)
    return _t(spark, sf, "events").select((F.col("event_id") + base).alias("big_id"),
                                          (F.col("user_id") + base).alias("big_user"))


def q_profile_big_ids(spark, sf):
    return api.profile_columns(_big_ids(spark, sf))


def q_mode_big_ids(spark, sf):
    return api.mode_by_column(_big_ids(spark, sf)).drop("mode")


def q_value_counts_big_ids(spark, sf):
    return api.column_charts(_big_ids(spark, sf))["value_counts"].drop("v")


def q_dispersion(spark, sf):
    return _round(api.dispersion(_t(spark, sf, "events")))


def q_question_stats(spark, sf):
    return _round(api.question_stats(_t(spark, sf, "orders")), overrides={"sum": 2})


def q_iqr_outliers(spark, sf):
    return api.iqr_outliers(_t(spark, sf, "events"), ["value"], ids=["event_id"])


def q_box_plot(spark, sf):
    return _round(api.box_plot(_t(spark, sf, "events")))


def q_value_counts(spark, sf):
    return api.value_counts(_t(spark, sf, "lineitem"), "l_quantity").drop("label")


def q_value_counts_binned(spark, sf):
    return _round(api.value_counts_binned(_t(spark, sf, "lineitem"), "l_quantity")
                  .drop("label"))


def q_value_counts_small(spark, sf):
    return _round(api.value_counts_binned(_t(spark, sf, "lineitem"), "l_linenumber")
                  .drop("label"))


def q_histogram10(spark, sf):
    return _round(api.histogram(_t(spark, sf, "events"), ["value"], 10).drop("label"))


def q_histogram20(spark, sf):
    return _round(api.histogram(_t(spark, sf, "orders"), ["o_totalprice"], 20).drop("label"))


def q_normal_overlay(spark, sf):
    return _round(api.normal_overlay(_t(spark, sf, "events"), "value"))


def q_qq_line(spark, sf):
    return _round(api.qq_line(_t(spark, sf, "customer"), ["c_acctbal"]))


def q_qq_points(spark, sf):
    return _round(api.qq_points(_t(spark, sf, "supplier"), ["s_acctbal"]))


def q_shapiro_wilk(spark, sf):
    return _round(api.shapiro_wilk(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]))


def q_statistical_insights(spark, sf):
    return _round(api.statistical_insights(_t(spark, sf, "events")).drop("message"))


def q_statistical_summary(spark, sf):
    return _round(api.statistical_summary(_t(spark, sf, "events")))


def q_quick_insights(spark, sf):
    return api.quick_insights(_t(spark, sf, "events"))


def q_adjacent_correlations(spark, sf):
    return _round(api.adjacent_correlations(_t(spark, sf, "lineitem")))


def q_correlation_matrix(spark, sf):
    return _round(api.correlation_matrix(_t(spark, sf, "lineitem")))


def q_shape(spark, sf):
    return api.shape(_t(spark, sf, "lineitem"))


def q_coerce_numeric(spark, sf):
    return _round(api.coercion_report(_events_text(spark, sf)))


def q_coerce_numeric_profile(spark, sf):
    return _round(api.coercion_report(_events_text(spark, sf), api.PROFILE_TERMS, 0.8,
                                      inclusive=True))


def q_coerce_numeric_values(spark, sf):
    return _round(api.coerce_numeric_profile(_events_text(spark, sf)))


def q_classify_columns(spark, sf):
    return api.classify_columns(_events_text(spark, sf), order_by=["event_id"])


def q_dropna_features(spark, sf):
    return api.dropna_features(_docs_labels(spark, sf), ["quality", "toxic"]).select(
        "doc_id", "quality", "toxic")


def q_preview(spark, sf):
    return api.preview(_t(spark, sf, "orders"), 10, order_by=["o_orderkey"])


def q_top_n(spark, sf):
    return api.top_n(_t(spark, sf, "orders"), 10, "o_totalprice", ["o_orderkey"])


def q_systematic_sample(spark, sf):
    return api.systematic_sample(_t(spark, sf, "orders"), "o_totalprice", ["o_orderkey"]
                                 ).drop("label")


def q_ask_top(spark, sf):
    return api.ask(_t(spark, sf, "orders"), "Show the top 25 orders by o_totalprice",
                   ["o_orderkey"]).frame


def q_ask_stats(spark, sf):
    return _round(api.ask(_t(spark, sf, "orders"), "What is the average o_totalprice?").frame,
                  overrides={"sum": 2})


def q_ask_default(spark, sf):
    return api.ask(_t(spark, sf, "orders"), "Tell me about this table",
                   ["o_orderkey"]).frame


def q_standard_scale(spark, sf):
    return _round(api.standard_scale(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"],
                                     keep=["c_custkey"]), 6)


def q_kmeans(spark, sf):
    return api.kmeans(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], k=3,
                      keep=["c_custkey"]).assignments.select("c_custkey", "cluster")


def q_cluster_sizes(spark, sf):
    res = api.kmeans(_t(spark, sf, "part"), ["p_size", "p_retailprice"], k=4,
                     keep=["p_partkey"])
    return api.cluster_sizes(res.assignments)


def q_dbscan_chain(spark, sf):
    """One feature whose values follow each other closely: one long cluster of many cells."""
    res = api.dbscan(_t(spark, sf, "customer"), ["c_custkey"], eps=0.0035, min_samples=2,
                     id_cols=["c_custkey"])
    return res.assignments.select("c_custkey", F.col("cluster").cast("int").alias("cluster"))


DBSCAN_3D = (["p_size", "p_retailprice", "p_partkey"], 0.25, 5)


def q_dbscan_3d(spark, sf):
    feats, eps, least = DBSCAN_3D
    res = api.dbscan(_t(spark, sf, "part"), feats, eps=eps, min_samples=least,
                     id_cols=["p_partkey"])
    return res.assignments.select("p_partkey", F.col("cluster").cast("int").alias("cluster"))


def q_dbscan_report(spark, sf):
    feats, eps, least = DBSCAN_3D
    rep = api.clustering_report(_t(spark, sf, "part"), feats, "dbscan", eps=eps,
                                min_samples=least, keep=["p_partkey"])
    return rep["points"].groupBy(F.col("cluster").cast("int").alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"))


def q_kmeans_checks(spark, sf):
    """Rows that break what k-means promises: nearest centre, centre of its rows, all rows."""
    cols = ["c_acctbal", "c_nationkey"]
    df = _t(spark, sf, "customer")
    res = api.kmeans(df, cols, k=3, keep=["c_custkey"])
    centers = res.centers.groupBy(F.col("cluster").alias("k")).pivot("feature", cols).agg(F.first("center"))
    a = res.assignments
    gap = sum(((F.col(f"_z{i}") - F.col(f"k{i}")) ** 2 for i in range(2)), F.lit(0.0))
    named = centers.select("k", *[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    near = (a.crossJoin(F.broadcast(named)).groupBy("c_custkey", "cluster")
            .agg(F.min_by("k", gap).alias("best")))
    means = a.groupBy("cluster").agg(*[F.avg(f"_z{i}").alias(f"m{i}") for i in range(2)]).join(
        named, F.col("cluster") == F.col("k"))
    off = F.greatest(*[F.abs(F.col(f"m{i}") - F.col(f"k{i}")) for i in range(2)])
    return (near.agg(F.count_if(F.col("best") != F.col("cluster")).alias("violations"))
            .select(F.lit("nearest").alias("check"), "violations")
            .unionByName(means.agg(F.count_if(off > 1e-3).alias("violations"))
                         .select(F.lit("centres").alias("check"), "violations"))
            .unionByName(api.cluster_sizes(a).agg(F.sum("size").alias("violations"))
                         .select(F.lit("rows").alias("check"), "violations")))


def q_clustering_centers(spark, sf):
    """Projected centres against the mean of the projected points of their cluster."""
    rep = api.clustering_report(_t(spark, sf, "part"), ["p_size", "p_retailprice", "p_partkey"],
                                num_clusters=3, keep=["p_partkey"])
    means = rep["points"].groupBy("cluster").agg(F.avg("pca_x").alias("x"), F.avg("pca_y").alias("y"))
    return rep["centers"].join(means, "cluster").select(
        F.col("cluster").cast("int").alias("cluster"),
        ((F.abs(F.col("pca_x") - F.col("x")) < 1e-2) & (F.abs(F.col("pca_y") - F.col("y")) < 1e-2))
        .alias("agrees"))


def q_cluster_feature_importance(spark, sf):
    res = api.kmeans(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                     k=3)
    return api.feature_importance(res)


def q_cluster_insights(spark, sf):
    res = api.kmeans(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], k=3)
    return api.cluster_insights(res)


def q_pca_projection(spark, sf):
    proj, _ = api.pca_projection(_t(spark, sf, "part"), ["p_size", "p_retailprice", "p_partkey"],
                                 keep=["p_partkey"])
    return proj


def q_clustering(spark, sf):
    rep = api.clustering_report(_t(spark, sf, "lineitem"),
                                ["l_quantity", "l_extendedprice", "l_discount"])
    return rep["points"]


def q_dbscan(spark, sf):
    res = api.dbscan(_t(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"], eps=0.5,
                     min_samples=5, id_cols=["s_suppkey"])
    return res.assignments.select("s_suppkey", F.col("cluster").cast("int").alias("cluster"))


def q_dbscan_customer(spark, sf):
    res = api.dbscan(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], eps=0.08,
                     min_samples=6, id_cols=["c_custkey"])
    return res.assignments.select("c_custkey", F.col("cluster").cast("int").alias("cluster"))


def q_dbscan_cluster_sizes(spark, sf):
    res = api.dbscan(_t(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"], eps=0.3,
                     min_samples=5, id_cols=["s_suppkey"])
    return api.cluster_sizes(res.assignments.withColumn("cluster", F.col("cluster").cast("int")))




def _round_trip(spark, sf, fmt):
    folder = api.scratch_folder(spark, f"io-{fmt}")
    src = _t(spark, sf, "orders")
    if fmt == "feather":
        api.write_feather(src, folder)
        path = folder
    else:
        api.write_result(src, folder, "csv" if fmt == "csv" else fmt)
        path = folder
    return api.read_table(spark, path, fmt)


def q_scan_csv(spark, sf):
    return _round_trip(spark, sf, "csv")


def q_scan_json(spark, sf):
    return _round_trip(spark, sf, "json")


def q_scan_json_array(spark, sf):
    """Documents of a bounded number of orders, each one array of records."""
    folder = api.scratch_folder(spark, "io-json-array")
    text = api.result_json(_t(spark, sf, "orders")).select(
        "json", F.floor(F.get_json_object("json", "$.o_orderkey").cast("long") / 5000).alias("doc"))
    (text.groupBy("doc").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("json")), F.lit("]")).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(folder))
    return api.read_table(spark, folder, "json")


def q_scan_json_columns(spark, sf):
    """Documents of the form {column: {index: value}}, as pandas writes them."""
    folder = api.scratch_folder(spark, "io-json-columns")
    rows = _t(spark, sf, "orders").withColumn("doc", F.floor(F.col("o_orderkey") / 5000))
    cells = [F.map_from_entries(F.collect_list(F.struct(
        F.col("o_orderkey").cast("string"), F.col(c)))).alias(c)
        for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")]
    (rows.groupBy("doc").agg(*cells)
     .select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")).alias("value"))
     .write.option("maxRecordsPerFile", 1).text(folder))
    return api.read_table(spark, folder, "json")


def q_scan_orc(spark, sf):
    return _round_trip(spark, sf, "orc")


def q_scan_parquet(spark, sf):
    return api.read_table(spark, f"{sf}/orders.parquet")


def q_scan_feather(spark, sf):
    return _round_trip(spark, sf, "feather")


def q_run_sql(spark, sf):
    views = {n: _t(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    return _round(api.run_sql(spark, STAR_SQL, views), 2)


def q_result_json(spark, sf):
    """The JSON rows parsed back."""
    rows = api.describe_numeric(_t(spark, sf, "lineitem"))
    back = F.from_json("json", rows.schema).alias("r")
    return _round(api.result_json(rows).select(back).select("r.*"))


def q_fingerprint(spark, sf):
    return api.fingerprint(_t(spark, sf, "orders"))


def q_column_types(spark, sf):
    """Types of the columns, with how many values of each a scan finds."""
    df = _t(spark, sf, "orders")
    found = api.missing_report(df)
    rows = api.shape(df).select("rows")
    return (api.column_types(df).join(found.select("column_name", "missing_count"), "column_name", "left")
            .crossJoin(rows).select("position", "column_name", "dtype",
                                    (F.col("rows") - F.coalesce("missing_count", F.lit(0))).alias("n_values")))


def q_classification(spark, sf):
    out = api.classification(_docs_labels(spark, sf).where(F.col("quality").isNotNull()),
                             "quality", ["n_chars"], ["doc_id"])
    return out["per_class"]


def q_linear_fit(spark, sf):
    return _round(api.linear_fit(_t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"))


def q_regression(spark, sf):
    return _round(api.regression(_t(spark, sf, "lineitem"), "l_extendedprice",
                                 ["l_quantity", "l_discount", "l_tax"],
                                 ["l_orderkey", "l_linenumber"],
                                 train=F.pmod("l_orderkey", F.lit(10)) < 8)["coefficients"], 2)


def q_classification_support(spark, sf):
    out = api.classification(_docs_labels(spark, sf).where(F.col("quality").isNotNull()),
                             "quality", ["n_chars"], ["doc_id"],
                             train=F.pmod("doc_id", F.lit(10)) < 8)
    return out["per_class"].select(
        "class", "support", F.col("correct").between(0, F.col("support")).alias("counted"))


def q_ts_monthly(spark, sf):
    return _round(api.ts_periodic(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
                  overrides={"total": 2})


def q_ts_moving_avg(spark, sf):
    return _round(api.ts_moving_avg(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 2)


def q_ts_trend_forecast(spark, sf):
    return _round(api.ts_trend_forecast(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
                  2)


def q_ts_seasonal_forecast(spark, sf):
    return _round(api.ts_seasonal_forecast(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice",
                                           ["o_orderpriority"]), 2)


def q_revenue_growth(spark, sf):
    return _round(api.revenue_growth(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
                  overrides={"revenue": 2})


def q_yoy(spark, sf):
    return _round(api.year_over_year(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
                  overrides={"revenue": 2})


def q_avg_transaction(spark, sf):
    return _round(api.avg_transaction(_t(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


def q_top_segments(spark, sf):
    line, orders, customer, nation, region = (
        _t(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region"))
    sales = (line.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    return _round(api.top_segments(sales, "r_name", "c_mktsegment", "amount"), 2)


def _gapped(spark: SparkSession, sf: str) -> DataFrame:
    """orders without April 1995, with some NaN prices, customers and dates missing."""
    o = _t(spark, sf, "orders")
    return o.where(~((F.year("o_orderdate") == 1995) & (F.month("o_orderdate") == 4))).select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("cust"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("day"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(
            F.col("o_totalprice")).alias("price"))


def q_revenue_growth_gaps(spark, sf):
    return _round(api.revenue_growth(_gapped(spark, sf), "day", "price"), overrides={"revenue": 2})


def q_ts_moving_avg_gaps(spark, sf):
    return _round(api.ts_moving_avg(_gapped(spark, sf), "day", "price"), 2)


def q_retention_gaps(spark, sf):
    return _round(api.retention(_gapped(spark, sf), "cust", "day"))


def q_retention(spark, sf):
    return _round(api.retention(_t(spark, sf, "orders"), "o_custkey", "o_orderdate"))


def q_clean_table(spark, sf):
    return _round(api.clean_table(_docs_labels(spark, sf).select(
        "doc_id", "lang", "n_chars", "quality", "toxic")))


def q_column_charts(spark, sf):
    return api.column_charts(_t(spark, sf, "orders"))["value_counts"].drop("value_text")


def q_column_charts_histogram(spark, sf):
    return _round(api.column_charts(_t(spark, sf, "orders").select("o_totalprice"))["histogram"].drop("label"))


def q_column_charts_samples(spark, sf):
    return api.column_charts(_t(spark, sf, "orders"), order_by=["o_orderkey"])["samples"].drop("label")


def q_table_context(spark, sf):
    return _round(api.table_context(_t(spark, sf, "customer"), ["c_custkey"])["describe"])


def q_analyze_statistical(spark, sf):
    return _round(api.analyze(_t(spark, sf, "events"), "statistical", column="value")
                  ["dispersion"])


STAR_SQL = """
SELECT r.r_name AS region, c.c_mktsegment AS segment,
       sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue, count(*) AS lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, c.c_mktsegment
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)}


# ---------------------------------------------------------------------------
# oracle SQL (DuckDB)

def _unpivot(table: str, cols: list[str], where: str = "") -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f"w AS (SELECT {sel} FROM {table} {where}), "
            f"l AS (UNPIVOT w ON {', '.join(cols)} INTO NAME column_name VALUE v)")


def _profile_sql(table: str = "", cols: list[tuple[str, str]] | None = None) -> str:
    if not table:
        cols = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                ("source", "string"), ("n_chars", "bigint"), ("quality", "int"),
                ("toxic", "int")]
        src = ("WITH j AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, "
               "l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ")
    else:
        src = f"WITH j AS (SELECT * FROM {table}) "
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, "
             f"count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS missing_count "
             f"FROM j" for i, (c, t) in enumerate(cols)]
    return src + " UNION ALL ".join(parts)


def _missing_sql() -> str:
    cols = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
    parts = [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
             f"round((count(*) - count({c})) * 100.0 / count(*), 4) AS pct_missing FROM j"
             for c in cols]
    return ("WITH j AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, "
            "l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
            "m AS (" + " UNION ALL ".join(parts) + ") SELECT * FROM m WHERE missing_count > 0")


SKEW_LABEL = ("CASE WHEN s IS NULL THEN NULL WHEN abs(s) < 0.5 THEN 'Approximately symmetric' "
              "WHEN abs(s) < 1.0 THEN 'Moderately skewed' "
              "WHEN s > 0 THEN 'Highly skewed to the right (positive)' "
              "ELSE 'Highly skewed to the left (negative)' END")
KURT_LABEL = ("CASE WHEN k IS NULL THEN NULL WHEN abs(k) < 0.5 THEN 'Approximately normal' "
              "WHEN k > 0 THEN 'Leptokurtic (heavier tails than normal)' "
              "ELSE 'Platykurtic (lighter tails than normal)' END")


def _quartiles(alias: str = "v") -> str:
    return (f"quantile_cont({alias}, 0.25) AS q1, quantile_cont({alias}, 0.5) AS median, "
            f"quantile_cont({alias}, 0.75) AS q3")


def _stats_cte(table: str, cols: list[str]) -> str:
    return (f"WITH {_unpivot(table, cols)}, st AS (SELECT column_name, count(v) AS n, "
            f"avg(v) AS mean, stddev_samp(v) AS std, min(v) AS mn, max(v) AS mx, "
            f"{_quartiles()} FROM l GROUP BY column_name), "
            f"f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper "
            f"FROM st)")


def _numpy_hist_sql(table: str, col: str, bins: int) -> str:
    # numpy.histogram binning: k = floor((v-lo)/w*B) clamped, then one-step edge fix.
    e = lambda k: f"CASE WHEN ({k}) >= {bins} THEN hi ELSE ({k}) * ((hi - lo) / {bins}) + lo END"
    k0 = f"least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1})"
    return (f"WITH r AS (SELECT CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 "
            f"ELSE min({col}) END AS lo, CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 "
            f"ELSE max({col}) END AS hi FROM {table}), "
            f"b AS (SELECT CAST({col} AS DOUBLE) AS v, lo, hi, {k0} AS k FROM {table}, r "
            f"WHERE {col} IS NOT NULL), "
            f"c AS (SELECT CASE WHEN v < ({e('k')}) THEN k - 1 "
            f"WHEN v >= ({e('k + 1')}) AND k < {bins - 1} THEN k + 1 ELSE k END AS bin, "
            f"count(*) AS cnt FROM b GROUP BY 1), "
            f"g AS (SELECT CAST(range AS INTEGER) AS bin, lo, hi FROM range({bins}), r) "
            f"SELECT '{col}' AS column_name, g.bin, round({e('g.bin')}, 4) AS lower, "
            f"round({e('(g.bin + 1)')}, 4) AS upper, "
            f"CAST(coalesce(c.cnt, 0) AS BIGINT) AS count FROM g LEFT JOIN c ON g.bin = c.bin")


def _cut_sql(table: str, col: str, bins: int = 10) -> str:
    # pandas.cut: right-closed bins, first edge lowered by 0.1% of the range.
    e = lambda k: (f"CASE WHEN ({k}) <= 0 THEN mn - (mx - mn) * 0.001 WHEN ({k}) >= {bins} "
                   f"THEN mx ELSE ({k}) * ((mx - mn) / {bins}) + mn END")
    m0 = (f"least(greatest(CAST(ceil((v - mn) / (mx - mn) * {bins}) AS BIGINT) - 1, 0), "
          f"{bins - 1})")
    return (f"WITH r AS (SELECT CAST(min({col}) AS DOUBLE) AS mn, CAST(max({col}) AS DOUBLE) AS mx "
            f"FROM {table}), b AS (SELECT CAST({col} AS DOUBLE) AS v, mn, mx, {m0} AS m "
            f"FROM {table}, r WHERE {col} IS NOT NULL), "
            f"c AS (SELECT CASE WHEN v > ({e('m + 1')}) THEN m + 1 "
            f"WHEN v <= ({e('m')}) AND m > 0 THEN m - 1 ELSE m END AS bin, count(*) AS cnt "
            f"FROM b GROUP BY 1), g AS (SELECT CAST(range AS INTEGER) AS bin, mn, mx "
            f"FROM range({bins}), r) "
            f"SELECT g.bin, round({e('g.bin')}, 4) AS lower, round({e('(g.bin + 1)')}, 4) AS upper, "
            f"CAST(coalesce(c.cnt, 0) AS BIGINT) AS count FROM g LEFT JOIN c ON g.bin = c.bin")


def _oracles() -> dict[str, str]:
    from tablescope.functions.normal import pdf_sql, ppf_sql
    o: dict[str, str] = {}
    o["describe_numeric"] = (
        f"WITH {_unpivot('lineitem', LINEITEM_NUM)} SELECT column_name, count(v) AS count, "
        "round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, "
        "round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, "
        "round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS max "
        "FROM l GROUP BY column_name")
    o["basic_stats"] = (
        f"WITH {_unpivot('orders', ORDERS_NUM)} SELECT column_name, count(v) AS count, "
        "round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, "
        "round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, "
        "round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3, "
        "round(max(v), 4) AS max, round(max(v) - min(v), 4) AS range, "
        "round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr "
        "FROM l GROUP BY column_name")
    o["profile_columns"] = _profile_sql()
    o["profile_pages"] = _profile_sql("pages", [("page_id", "bigint"), ("url", "string"),
                                                ("html", "string")])
    o["profile_conversations"] = _profile_sql(
        "conversations", [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                          ("text", "string")])
    o["profile_embeddings"] = _profile_sql(
        "embeddings", [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")])
    o["value_counts_text"] = ("SELECT role AS value, count(*) AS count FROM conversations "
                              "WHERE role IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20")
    o["missing_report"] = _missing_sql()
    o["skewness_by_column"] = (
        f"WITH {_unpivot('events', EVENTS_NUM)}, s AS (SELECT column_name, skewness(v) AS s "
        f"FROM l GROUP BY column_name) SELECT column_name, round(s, 4) AS skewness, "
        f"{SKEW_LABEL} AS interpretation FROM s")
    o["kurtosis_by_column"] = (
        f"WITH {_unpivot('events', EVENTS_NUM)}, s AS (SELECT column_name, kurtosis(v) AS k "
        f"FROM l GROUP BY column_name) SELECT column_name, round(k, 4) AS kurtosis, "
        f"{KURT_LABEL} AS interpretation FROM s")
    o["mode_by_column"] = (
        f"WITH {_unpivot('lineitem', LINEITEM_NUM)}, c AS (SELECT column_name, v, count(*) AS cnt "
        f"FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name "
        f"ORDER BY cnt DESC, v ASC) AS rn FROM c) SELECT column_name, round(v, 4) AS mode "
        f"FROM r WHERE rn = 1")
    o["dispersion"] = (
        f"WITH {_unpivot('events', EVENTS_NUM)} SELECT column_name, "
        "round(quantile_cont(v, 0.5), 4) AS median, round(max(v) - min(v), 4) AS range, "
        "round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr, "
        "round(CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / avg(v) * 100 END, 4) "
        "AS coefficient_of_variation FROM l GROUP BY column_name")
    o["question_stats"] = (
        f"WITH {_unpivot('orders', ORDERS_NUM)} SELECT column_name, round(avg(v), 4) AS mean, "
        "round(quantile_cont(v, 0.5), 4) AS median, round(min(v), 4) AS min, "
        "round(max(v), 4) AS max, round(sum(v), 2) AS sum FROM l GROUP BY column_name")
    o["iqr_outliers"] = (
        "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 "
        "FROM events) SELECT event_id, 'value' AS column_name, CAST(value AS DOUBLE) AS v "
        "FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
    o["box_plot"] = (
        f"{_stats_cte('events', EVENTS_NUM)} SELECT f.column_name, round(mn, 4) AS min, "
        "round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
        "round(mx, 4) AS max, (SELECT count(*) FROM l WHERE l.column_name = f.column_name "
        "AND (l.v < f.lower OR l.v > f.upper)) AS outlier_count FROM f")
    o["value_counts"] = ("SELECT l_quantity AS value, count(*) AS count FROM lineitem "
                         "WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20")
    o["value_counts_binned"] = _cut_sql("lineitem", "l_quantity")
    o["value_counts_small"] = (
        "SELECT CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS bin, v AS lower, "
        "v AS upper, cnt AS count FROM (SELECT CAST(l_linenumber AS DOUBLE) AS v, "
        "count(*) AS cnt FROM lineitem GROUP BY 1)")
    o["histogram10"] = _numpy_hist_sql("events", "value", 10)
    o["histogram20"] = _numpy_hist_sql("orders", "o_totalprice", 20)
    o["normal_overlay"] = (
        "WITH s AS (SELECT min(value) AS mn, max(value) AS mx, avg(value) AS mean, "
        "stddev_samp(value) AS std, count(value) AS n FROM events), "
        "p AS (SELECT CAST(range AS INTEGER) AS i, CASE WHEN range = 99 THEN mx ELSE "
        "range * ((mx - mn) / 99) + mn END AS x, mn, mx, mean, std, n FROM range(100), s) "
        f"SELECT i, round(x, 4) AS x, round({pdf_sql('x', 'mean', 'std')} * n * (mx - mn) / 20, 4)"
        " AS y FROM p")
    filliben = ("CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) "
                "ELSE (i - 0.3175) / (n + 0.365) END")
    qq = lambda table, col: (
        f"WITH r AS (SELECT '{col}' AS column_name, CAST({col} AS DOUBLE) AS sample, "
        f"row_number() OVER (ORDER BY {col}) AS i, count(*) OVER () AS n FROM {table} "
        f"WHERE {col} IS NOT NULL), m AS (SELECT *, {filliben} AS mq FROM r), "
        f"t AS (SELECT column_name, i, {ppf_sql('mq')} AS theoretical, sample FROM m)")
    o["qq_points"] = (qq("supplier", "s_acctbal") + " SELECT column_name, i, "
                      "round(theoretical, 4) AS theoretical, round(sample, 4) AS sample FROM t")
    o["qq_line"] = (qq("customer", "c_acctbal") + " SELECT column_name, "
                    "round(regr_slope(sample, theoretical), 4) AS slope, "
                    "round(regr_intercept(sample, theoretical), 4) AS intercept, "
                    "round(corr(theoretical, sample), 4) AS r FROM t GROUP BY column_name")
    o["adjacent_correlations"] = " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 4) AS corr FROM lineitem"
        for a, b in zip(LINEITEM_NUM[:3], LINEITEM_NUM[1:4]))
    o["correlation_matrix"] = " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(CASE WHEN stddev_pop({a}) = 0 OR "
        f"stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END, 4) AS corr FROM lineitem"
        for i, a in enumerate(LINEITEM_NUM) for b in LINEITEM_NUM[i + 1:])
    o["shape"] = "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem"
    ev_text = ("et AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k') "
               "AS props_num, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) "
               "END AS amount_txt FROM events)")
    pat = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"
    parse = lambda c: (f"CASE WHEN regexp_matches({c}, '{pat}') THEN "
                       f"TRY_CAST(trim({c}) AS DOUBLE) END")
    ratio = lambda c: f"avg(CASE WHEN ({parse(c)}) IS NOT NULL THEN 1.0 ELSE 0.0 END)"
    o["coerce_numeric"] = (
        f"WITH {ev_text}, r AS (SELECT 'props_num' AS column_name, {ratio('props_num')} AS pr "
        f"FROM et UNION ALL SELECT 'amount_txt', {ratio('amount_txt')} FROM et) "
        "SELECT column_name, round(pr, 4) AS parse_ratio, pr > 0.8 AS converted FROM r")
    o["coerce_numeric_profile"] = (
        f"WITH {ev_text}, r AS (SELECT 'props_num' AS column_name, {ratio('props_num')} AS pr "
        f"FROM et UNION ALL SELECT 'amount_txt', {ratio('amount_txt')} FROM et) "
        "SELECT column_name, round(pr, 4) AS parse_ratio, pr >= 0.8 AS converted FROM r")
    o["coerce_numeric_values"] = (
        f"WITH {ev_text} SELECT event_id, event_type, round(value, 4) AS value, "
        f"round({parse('props_num')}, 4) AS props_num, round({parse('amount_txt')}, 4) "
        "AS amount_txt FROM et")
    o["classify_columns"] = (
        "SELECT * FROM (VALUES (0, 'event_id', 'bigint', 'numeric'), "
        "(1, 'event_type', 'text', 'text'), (2, 'value', 'double', 'numeric'), "
        f"(3, 'props_num', CASE WHEN (SELECT {ratio('props_num')} FROM (SELECT * FROM et "
        "WHERE props_num IS NOT NULL ORDER BY event_id LIMIT 100)) > 0.8 THEN 'numeric' "
        "ELSE 'text' END, CASE WHEN (SELECT "
        f"{ratio('props_num')} FROM (SELECT * FROM et WHERE props_num IS NOT NULL ORDER BY "
        "event_id LIMIT 100)) > 0.8 THEN 'numeric' ELSE 'text' END), "
        "(4, 'amount_txt', 'text', 'text')) AS t(position, column_name, type, category)")
    o["classify_columns"] = f"WITH {ev_text} " + o["classify_columns"].replace(
        " ORDER BY event_id LIMIT 100", "")
    o["dropna_features"] = ("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l "
                            "ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL "
                            "AND l.toxic IS NOT NULL")
    o["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"
    o["top_n"] = "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10"
    o["ask_top"] = "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25"
    o["ask_stats"] = ("SELECT 'o_totalprice' AS column_name, round(avg(o_totalprice), 4) AS mean, "
                      "round(median(o_totalprice), 4) AS median, round(min(o_totalprice), 4) AS min, "
                      "round(max(o_totalprice), 4) AS max, round(sum(o_totalprice), 2) AS sum "
                      "FROM orders")
    o["ask_default"] = o["preview"]
    o["systematic_sample"] = (
        "WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT row_number() OVER "
        "(ORDER BY o_orderkey) - 1 AS idx, CAST(o_totalprice AS DOUBLE) AS value FROM orders) "
        "SELECT idx, value FROM r, n WHERE value IS NOT NULL AND (n.n <= 100 OR "
        "(idx % (n.n // 100) = 0 AND idx < (n.n // 100) * 100))")
    o["standard_scale"] = (
        "WITH s AS (SELECT avg(c_acctbal) ma, stddev_pop(c_acctbal) sa, avg(c_nationkey) mn, "
        "stddev_pop(c_nationkey) sn FROM customer) SELECT c_custkey, "
        "round((c_acctbal - ma) / sa, 6) AS c_acctbal, round((c_nationkey - mn) / sn, 6) "
        "AS c_nationkey FROM customer, s")
    o["dbscan"] = _dbscan_sql("supplier", "s_suppkey", ["s_acctbal", "s_nationkey"], 0.5, 5)
    o["dbscan_customer"] = _dbscan_sql("customer", "c_custkey", ["c_acctbal", "c_nationkey"],
                                       0.08, 6)
    o["dbscan_cluster_sizes"] = (
        "WITH q AS (" + _dbscan_sql("supplier", "s_suppkey", ["s_acctbal", "s_nationkey"], 0.3, 5)
        + ") SELECT cluster, count(*) AS size FROM q GROUP BY cluster")
    for k in ("scan_orc", "scan_parquet", "scan_feather"):
        o[k] = "SELECT * FROM orders"
    # Text formats hold timestamps as text, which pandas leaves as text too.
    o["scan_csv"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate) FROM orders"
    o["scan_json"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders"
    o["scan_json_array"] = o["scan_json"]
    o["scan_json_columns"] = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"
    big = "9007199254740992"
    ids = (f"b AS (SELECT event_id + {big} AS big_id, user_id + {big} AS big_user FROM events), "
           "u AS (SELECT 'big_id' AS column_name, big_id AS v FROM b UNION ALL "
           "SELECT 'big_user', big_user FROM b), "
           "c AS (SELECT column_name, v, count(*) AS cnt FROM u WHERE v IS NOT NULL GROUP BY 1, 2)")
    o["profile_big_ids"] = (
        f"WITH {ids} SELECT CAST(CASE column_name WHEN 'big_id' THEN 0 ELSE 1 END AS INTEGER) AS position, "
        "column_name, 'bigint' AS dtype, count(DISTINCT v) AS unique_count, "
        "count(*) - count(v) AS missing_count FROM u GROUP BY column_name")
    o["mode_big_ids"] = (
        f"WITH {ids} SELECT column_name, CAST(v AS VARCHAR) AS mode_text FROM (SELECT *, row_number() "
        "OVER (PARTITION BY column_name ORDER BY cnt DESC, v) AS n FROM c) WHERE n = 1")
    o["value_counts_big_ids"] = (
        f"WITH {ids} SELECT column_name, CAST(v AS VARCHAR) AS value_text, cnt AS count FROM (SELECT *, "
        "row_number() OVER (PARTITION BY column_name ORDER BY v) AS n FROM c) WHERE n <= 20")
    o["dbscan_chain"] = (
        "WITH z AS (SELECT c_custkey, (c_custkey - avg(c_custkey) OVER ()) / stddev_pop(c_custkey) OVER () AS z "
        "FROM customer), g AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS n FROM z WINDOW w AS (ORDER BY z)), "
        "f AS (SELECT *, z - p <= 0.0035 AS back, n - z <= 0.0035 AS ahead FROM g), "
        "k AS (SELECT *, coalesce(back, false) OR coalesce(ahead, false) AS core, "
        "sum(CASE WHEN coalesce(back, false) THEN 0 ELSE 1 END) OVER (ORDER BY z) AS island FROM f), "
        "r AS (SELECT island, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS cluster FROM k WHERE core GROUP BY island) "
        "SELECT c_custkey, CAST(CASE WHEN core THEN cluster ELSE -1 END AS INTEGER) AS cluster "
        "FROM k LEFT JOIN r USING (island)")
    feats, eps, least = DBSCAN_3D
    o["dbscan_3d"] = _dbscan_sql("part", "p_partkey", feats, eps, least)
    o["dbscan_report"] = ("WITH q AS (" + o["dbscan_3d"]
                          + ") SELECT cluster, count(*) AS size FROM q GROUP BY cluster")
    o["kmeans_checks"] = ("SELECT 'nearest' AS \"check\", CAST(0 AS BIGINT) AS violations UNION ALL "
                          "SELECT 'centres', 0 UNION ALL SELECT 'rows', count(*) FROM customer")
    o["clustering_centers"] = "SELECT CAST(range AS INTEGER) AS cluster, true AS agrees FROM range(3)"
    o["column_charts_histogram"] = _numpy_hist_sql("orders", "o_totalprice", 10)
    sample = o["systematic_sample"]
    o["column_charts_samples"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, idx, value FROM (" + sample.replace("o_totalprice", c) + ")"
        for c in ORDERS_NUM)
    o["classification_support"] = (
        "SELECT CAST(quality AS VARCHAR) AS class, count(*) AS support, true AS counted FROM documents d "
        "JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND n_chars IS NOT NULL "
        "AND d.doc_id % 10 >= 8 GROUP BY 1")
    xs = ["l_quantity", "l_discount", "l_tax"]
    v = lambda a, b: f"covar_pop({a}, {b})"
    cov = [[v(a, b) for b in xs] for a in xs]
    rhs = [v(a, "l_extendedprice") for a in xs]
    det = lambda m: " + ".join(
        f"{sign} ({m[0][i]}) * (({m[1][j]}) * ({m[2][k]}) - ({m[1][k]}) * ({m[2][j]}))"
        for i, j, k, sign in ((0, 1, 2, "1.0 *"), (1, 0, 2, "-1.0 *"), (2, 0, 1, "1.0 *")))
    coefs = [f"({det([[rhs[r] if c == i else cov[r][c] for c in range(3)] for r in range(3)])}) / ({det(cov)})"
             for i in range(3)]
    o["regression"] = (
        "WITH b AS (SELECT " + ", ".join(f"{c} AS b{i}" for i, c in enumerate(coefs))
        + ", avg(l_extendedprice) AS my, " + ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(xs))
        + " FROM lineitem WHERE l_orderkey % 10 < 8) "
        + " UNION ALL ".join(f"SELECT '{x}' AS term, round(b{i}, 2) AS coefficient FROM b" for i, x in enumerate(xs))
        + " UNION ALL SELECT '(intercept)', round(my - b0 * m0 - b1 * m1 - b2 * m2, 2) FROM b")
    o["result_json"] = o["describe_numeric"]
    gap = ("g AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS cust, "
           "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS day, "
           "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders "
           "WHERE NOT (year(o_orderdate) = 1995 AND month(o_orderdate) = 4)), "
           "p AS (SELECT date_trunc('month', day) AS period, sum(price) AS total FROM g "
           "WHERE day IS NOT NULL GROUP BY 1), cal AS (SELECT unnest(generate_series((SELECT min(period) FROM p), "
           "(SELECT max(period) FROM p), INTERVAL 1 MONTH)) AS period), "
           "f AS (SELECT CAST(cal.period AS TIMESTAMP) AS period, total FROM cal LEFT JOIN p ON cal.period = p.period)")
    o["revenue_growth_gaps"] = (
        f"WITH {gap} SELECT period, round(total, 2) AS revenue, round(CASE WHEN lag(total) OVER "
        "(ORDER BY period) <> 0 THEN (total - lag(total) OVER (ORDER BY period)) / "
        "lag(total) OVER (ORDER BY period) * 100 END, 4) AS growth_pct FROM f")
    o["ts_moving_avg_gaps"] = (
        f"WITH {gap} SELECT period, round(total, 2) AS total, round(avg(total) OVER (ORDER BY period "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg FROM f")
    o["retention_gaps"] = (
        f"WITH {gap}, a AS (SELECT DISTINCT cust, date_trunc('month', day) AS period FROM g "
        "WHERE cust IS NOT NULL AND day IS NOT NULL), j AS (SELECT a.period, b.cust AS back FROM a LEFT JOIN a b ON "
        "a.cust = b.cust AND b.period = a.period + INTERVAL 1 MONTH) SELECT CAST(period AS TIMESTAMP) AS period, "
        "count(*) AS active, count(back) AS retained, round(count(back) * 100.0 / count(*), 4) "
        "AS retention_pct FROM j GROUP BY period")
    o["run_sql"] = ("SELECT region, segment, round(revenue, 2) AS revenue, lines FROM ("
                    + STAR_SQL + ")")
    o["column_types"] = (
        "SELECT t.*, CASE position WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 "
        "WHEN 4 THEN n4 ELSE n5 END AS n_values FROM (VALUES (0, 'o_orderkey', 'bigint'), "
        "(1, 'o_custkey', 'bigint'), "
        "(2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), "
        "(4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) "
        "AS t(position, column_name, dtype), (SELECT count(o_orderkey) AS n0, count(o_custkey) AS n1, "
        "count(o_orderstatus) AS n2, count(o_totalprice) AS n3, count(o_orderdate) AS n4, "
        "count(o_orderpriority) AS n5 FROM orders)")
    o["linear_fit"] = (
        "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, "
        "round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, "
        "round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, "
        "CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
    per = ("per AS (SELECT date_trunc('month', o_orderdate) AS period, count(*) AS n, "
           "sum(o_totalprice) AS total, avg(o_totalprice) AS average FROM orders GROUP BY 1)")
    o["ts_monthly"] = (f"WITH {per} SELECT period, n, round(total, 2) AS total, "
                       "round(average, 4) AS average FROM per")
    o["ts_moving_avg"] = (f"WITH {per} SELECT period, round(total, 2) AS total, "
                          "round(avg(total) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING "
                          "AND CURRENT ROW), 2) AS moving_avg FROM per")
    o["ts_trend_forecast"] = (
        f"WITH {per}, i AS (SELECT period, total, row_number() OVER (ORDER BY period) - 1 AS t "
        "FROM per), f AS (SELECT regr_slope(total, t) AS slope, regr_intercept(total, t) AS "
        "intercept, max(t) AS last_t, max(period) AS last_period FROM i) "
        "SELECT CAST(s.step AS INTEGER) AS step, last_period + to_months(CAST(s.step AS INTEGER)) "
        "AS period, round(intercept + slope * (last_t + s.step), 2) AS forecast "
        "FROM f, (SELECT range AS step FROM range(1, 4)) s")
    o["ts_seasonal_forecast"] = (
        "WITH RECURSIVE p AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS "
        "period, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2), "
        "c AS (SELECT k, unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, "
        "INTERVAL 1 MONTH)) AS period FROM p GROUP BY k), "
        "s AS (SELECT c.k, c.period, p.y, row_number() OVER (PARTITION BY c.k ORDER BY c.period) "
        "AS t FROM c LEFT JOIN p ON p.k = c.k AND p.period = c.period), "
        "i AS (SELECT k, avg(y) FILTER (t <= 12) AS m1, avg(y) FILTER (t BETWEEN 13 AND 24) AS m2, "
        "avg(y) AS m, max(period) AS hi FROM s GROUP BY k), "
        "h AS (SELECT s.k, list(coalesce(s.y - coalesce(i.m1, i.m), 0) ORDER BY s.t) AS terms "
        "FROM s JOIN i ON i.k = s.k WHERE s.t <= 12 GROUP BY s.k), "
        "r AS (SELECT i.k, CAST(12 AS BIGINT) AS t, coalesce(m1, m) AS level, "
        "coalesce((m2 - m1) / 12, 0) AS trend, h.terms FROM i JOIN h ON h.k = i.k UNION ALL "
        "SELECT k, t, lv, CASE WHEN y IS NULL THEN trend ELSE 0.1 * (lv - level) + 0.9 * trend END, "
        "list_append(terms[2:12], CASE WHEN y IS NULL THEN terms[1] ELSE 0.2 * (y - lv) + "
        "0.8 * terms[1] END) FROM (SELECT r.k, s.t, s.y, r.level, r.trend, r.terms, "
        "CASE WHEN s.y IS NULL THEN r.level + r.trend ELSE 0.3 * (s.y - r.terms[1]) + "
        "0.7 * (r.level + r.trend) END AS lv FROM r JOIN s ON s.k = r.k AND s.t = r.t + 1)) "
        "SELECT i.k AS o_orderpriority, CAST(g.step AS INTEGER) AS step, "
        "i.hi + to_months(CAST(g.step AS INTEGER)) AS period, "
        "round(r.level + g.step * r.trend + r.terms[g.step], 2) AS forecast FROM r "
        "JOIN (SELECT k, max(t) AS t FROM r GROUP BY k) z ON z.k = r.k AND z.t = r.t "
        "JOIN i ON i.k = r.k, (SELECT range AS step FROM range(1, 7)) g")
    o["revenue_growth"] = (
        f"WITH {per} SELECT period, round(total, 2) AS revenue, round(CASE WHEN lag(total) OVER "
        "(ORDER BY period) <> 0 THEN (total - lag(total) OVER (ORDER BY period)) / "
        "lag(total) OVER (ORDER BY period) * 100 END, 4) AS growth_pct FROM per")
    o["yoy"] = (
        "WITH y AS (SELECT date_trunc('year', o_orderdate) AS period, sum(o_totalprice) AS total "
        "FROM orders GROUP BY 1) SELECT CAST(year(period) AS INTEGER) AS year, "
        "round(total, 2) AS revenue, round(CASE WHEN lag(total) OVER (ORDER BY period) <> 0 THEN "
        "(total - lag(total) OVER (ORDER BY period)) / lag(total) OVER (ORDER BY period) * 100 "
        "END, 4) AS yoy_pct FROM y")
    o["avg_transaction"] = f"WITH {per} SELECT period, n, round(average, 4) AS avg_value FROM per"
    o["top_segments"] = (
        "WITH s AS (SELECT region AS r_name, segment AS c_mktsegment, revenue FROM ("
        + STAR_SQL + ")), k AS (SELECT *, rank() OVER (PARTITION BY r_name ORDER BY revenue DESC, "
        "c_mktsegment) AS rank FROM s) SELECT r_name, c_mktsegment, round(revenue, 2) AS revenue,"
        " CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
    o["retention"] = (
        "WITH a AS (SELECT DISTINCT o_custkey AS cust, date_trunc('month', o_orderdate) AS period "
        "FROM orders), j AS (SELECT a.period, b.cust AS back FROM a LEFT JOIN a b ON "
        "a.cust = b.cust AND b.period = a.period + INTERVAL 1 MONTH) SELECT period, "
        "count(*) AS active, count(back) AS retained, round(count(back) * 100.0 / count(*), 4) "
        "AS retention_pct FROM j GROUP BY period")
    cl = ["doc_id", "n_chars", "quality", "toxic"]
    stats_sql = ", ".join(
        f"quantile_cont({c}, 0.5) AS med_{c}, quantile_cont({c}, 0.25) AS q1_{c}, "
        f"quantile_cont({c}, 0.75) AS q3_{c}" for c in cl)
    fix = lambda c: (f"round(least(greatest(coalesce(CAST({c} AS DOUBLE), med_{c}), "
                     f"q1_{c} - 1.5 * (q3_{c} - q1_{c})), q3_{c} + 1.5 * (q3_{c} - q1_{c})), 4) "
                     f"AS {c}")
    o["clean_table"] = (
        "WITH j AS (SELECT d.doc_id, trim(d.lang) AS lang, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
        f"s AS (SELECT {stats_sql} FROM j) SELECT lang, "
        + ", ".join(fix(c) for c in cl) + " FROM j, s")
    ocols = ["o_orderkey", "o_custkey", "o_totalprice"]
    o["column_charts"] = " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v, count(*) AS count "
        f"FROM orders GROUP BY 2 ORDER BY 2 LIMIT 20)" for c in ocols)
    o["table_context"] = (
        f"WITH {_unpivot('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])} SELECT "
        "column_name, count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,"
        " round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q1, "
        "round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, "
        "round(max(v), 4) AS max FROM l GROUP BY column_name")
    o["analyze_statistical"] = (
        "SELECT 'value' AS column_name, round(quantile_cont(value, 0.5), 4) AS median, "
        "round(max(value) - min(value), 4) AS range, round(quantile_cont(value, 0.75) - "
        "quantile_cont(value, 0.25), 4) AS iqr, round(CASE WHEN avg(value) <> 0 THEN "
        "stddev_samp(value) / avg(value) * 100 END, 4) AS coefficient_of_variation FROM events")
    o["statistical_insights"] = _insights_sql("events", EVENTS_NUM)
    o["shapiro_wilk"] = _shapiro_sql("customer", ["c_acctbal", "c_nationkey"])
    o["statistical_summary"] = _summary_sql("events", EVENTS_NUM)
    o["quick_insights"] = _quick_sql()
    return o


def _facts_sql(table: str, cols: list[str]) -> str:
    """Per-column numbers the insight rules use (DuckDB skewness/kurtosis are the
    bias-corrected pandas versions)."""
    return (
        f"{_unpivot(table, cols)}, rc AS (SELECT count(*) AS r FROM {table}), "
        "st AS (SELECT column_name, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, "
        "min(v) AS mn, max(v) AS mx, skewness(v) AS sk, kurtosis(v) AS ku, "
        "quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 "
        "FROM l GROUP BY column_name), "
        "oc AS (SELECT l.column_name, count(*) AS o FROM l JOIN st USING (column_name) "
        "WHERE l.v < st.q1 - 1.5 * (st.q3 - st.q1) OR l.v > st.q3 + 1.5 * (st.q3 - st.q1) "
        "GROUP BY l.column_name), "
        "g AS (SELECT st.*, rc.r, coalesce(oc.o, 0) AS outliers, rc.r - st.n AS missing, "
        "(rc.r - st.n) * 100.0 / rc.r AS mp, coalesce(oc.o, 0) * 100.0 / st.n AS op, "
        "CASE WHEN mean <> 0 THEN std / mean * 100 END AS cv FROM st CROSS JOIN rc "
        "LEFT JOIN oc USING (column_name))")


def _insights_sql(table: str, cols: list[str]) -> str:
    normal = "(abs(sk) < 0.5 AND abs(ku) < 0.5)"
    nonnormal = f"(NOT {normal} AND (abs(sk) > 1 OR abs(ku) > 1))"
    rules = [
        (normal, "'normality'", "'success'", "'Normal Distribution'", "sk"),
        (nonnormal, "'normality'", "'warning'", "'Non-Normal Distribution'", "sk"),
        (f"{nonnormal} AND abs(sk) > 1.5", "'transformation'", "'info'",
         "'Transformation Suggestion'", "sk"),
        ("outliers > 0", "'outliers'", "CASE WHEN op > 2 THEN 'warning' ELSE 'info' END",
         "'Outliers Detected'", "op"),
        ("missing > 0", "'missing'", "CASE WHEN mp > 15 THEN 'danger' WHEN mp > 5 THEN 'warning' "
         "ELSE 'info' END", "'Missing Values'", "mp"),
        ("cv > 30", "'variability'", "'info'", "'High Variability'", "cv"),
        ("cv < 5", "'variability'", "'info'", "'Low Variability'", "cv"),
        ("abs(ku) > 1.5", "'shape'", "'info'", "'Distribution Shape'", "ku"),
    ]
    body = " UNION ALL ".join(
        f"SELECT column_name, {r} AS rule, {sv} AS severity, {t} AS title, "
        f"round({m}, 4) AS metric FROM g WHERE {c}" for c, r, sv, t, m in rules)
    return f"WITH {_facts_sql(table, cols)} {body}"


def _shapiro_core(table: str, col: str) -> str:
    """Shapiro-Wilk (Royston 1995) for one column as SQL; NULL unless 3 <= n < 5000."""
    from tablescope.functions.normal import lower_tail_sql, ppf_sql
    u = "(1.0 / sqrt(n))"
    poly = lambda cs: " + ".join(f"({c!r}) * pow({u}, {k})" for k, c in enumerate(cs) if c)
    a_n = f"m_n / sqrt(msum) + {poly([0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056])}"
    a_n1 = f"m_n1 / sqrt(msum) + {poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])}"
    z = ("CASE WHEN n <= 11 THEN (-ln((0.459 * n - 2.273) - ln(1 - w)) - (0.5440 - 0.39978 * n "
         "+ 0.025054 * n * n - 0.0006714 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n"
         " * n - 0.0020322 * n * n * n) ELSE (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 "
         "* ln(n) * ln(n) + 0.0038915 * ln(n) * ln(n) * ln(n))) / exp(-0.4803 - 0.082676 * ln(n) "
         "+ 0.0030302 * ln(n) * ln(n)) END")
    tail = lower_tail_sql("zz")
    ai = ("CASE WHEN n = 3 THEN CASE WHEN i = 1 THEN -sqrt(0.5) WHEN i = 3 THEN sqrt(0.5) ELSE 0 "
          "END WHEN i = n THEN a_n WHEN i = 1 THEN -a_n WHEN n > 5 AND i = n - 1 THEN a_n1 "
          "WHEN n > 5 AND i = 2 THEN -a_n1 ELSE m / sqrt(eps) END")
    return (
        f"x AS (SELECT CAST({col} AS DOUBLE) AS v FROM {table} WHERE {col} IS NOT NULL), "
        "xs AS (SELECT count(*) AS n, min(v) AS mn, max(v) AS mx FROM x), "
        "r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, xs.n FROM x, xs "
        "WHERE xs.n >= 3 AND xs.n < 5000 AND xs.mn < xs.mx), "
        f"m AS (SELECT *, {ppf_sql('(i - 0.375) / (n + 0.25)')} AS m FROM r), "
        "a AS (SELECT n, sum(m * m) AS msum, max(CASE WHEN i = n THEN m END) AS m_n, "
        "max(CASE WHEN i = n - 1 THEN m END) AS m_n1, avg(v) AS mean FROM m GROUP BY n), "
        f"c AS (SELECT *, {a_n} AS a_n, {a_n1} AS a_n1 FROM a), "
        "c2 AS (SELECT *, CASE WHEN n > 5 THEN (msum - 2 * m_n * m_n - 2 * m_n1 * m_n1) / "
        "(1 - 2 * a_n * a_n - 2 * a_n1 * a_n1) ELSE (msum - 2 * m_n * m_n) / (1 - 2 * a_n * a_n) "
        "END AS eps FROM c), "
        f"w0 AS (SELECT c2.n, sum(({ai}) * v) AS num, sum((v - mean) * (v - mean)) AS ss "
        "FROM m JOIN c2 USING (n) GROUP BY c2.n), "
        "w1 AS (SELECT n, least(1.0, num * num / ss) AS w FROM w0), "
        f"w2 AS (SELECT n, w, {z} AS zz FROM w1), "
        "sw AS (SELECT n, w, CASE WHEN n = 3 THEN greatest(0.0, 6 / pi() * (asin(sqrt(w)) - "
        f"asin(sqrt(0.75)))) WHEN w >= 1 THEN 1.0 ELSE CASE WHEN zz > 0 THEN {tail} "
        f"ELSE 1 - {tail} END END AS p FROM w2)")


def _shapiro_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"(WITH {_shapiro_core(table, c)} SELECT '{c}' AS column_name, xs.n, "
            "round(sw.w, 4) AS W, round(sw.p, 4) AS p_value, CASE WHEN sw.p IS NULL THEN "
            "'Not tested' WHEN sw.p > 0.05 THEN 'Normal distribution' ELSE 'Non-normal distribution' END "
            "AS interpretation FROM xs LEFT JOIN sw ON true)")
    return " UNION ALL ".join(parts)


def _summary_sql(table: str, cols: list[str]) -> str:
    sw = " UNION ALL ".join(
        f"(WITH {_shapiro_core(table, c)} SELECT '{c}' AS column_name, CASE WHEN sw.p IS NULL "
        "THEN 'Not tested' WHEN sw.p > 0.05 THEN 'Normal distribution' ELSE 'Non-normal distribution' END AS dt "
        "FROM xs LEFT JOIN sw ON true)" for c in cols)
    return (
        f"WITH {_facts_sql(table, cols)}, sw AS ({sw}), "
        "mc AS (SELECT column_name, v, count(*) AS cnt FROM l GROUP BY 1, 2), "
        "mo AS (SELECT column_name, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY "
        "column_name ORDER BY cnt DESC, v) AS rn FROM mc) WHERE rn = 1) "
        "SELECT g.column_name, sw.dt AS distribution_type, round(mean, 4) AS mean, "
        "round(med, 4) AS median, round(mode, 4) AS mode, round(mx - mn, 4) AS range, "
        "round(std, 4) AS std, round(q3 - q1, 4) AS iqr, round(cv, 4) AS coefficient_of_variation,"
        " missing AS missing_values, round(mp, 4) AS missing_pct, outliers AS outlier_count, "
        "round(op, 4) AS outlier_pct FROM g JOIN sw USING (column_name) "
        "JOIN mo USING (column_name)")


def _quick_sql() -> str:
    facts = _facts_sql("events", EVENTS_NUM)
    lines = [
        "SELECT 'insight' AS section, 0 AS seq, 'The dataset contains ' || (SELECT count(*) "
        "FROM events) || ' rows and 6 columns.' AS text",
        "SELECT 'insight', 1, 'Key columns for analysis include: event_id, ts, user_id.'",
        "SELECT 'insight', 2, 'Numeric columns: event_id, user_id, value.'",
        "SELECT 'insight', 3, 'Text columns: event_type, props.'",
        "SELECT 'insight', 4, 'Date columns: ts.'",
        "SELECT 'insight', 100 + CASE column_name WHEN 'event_id' THEN 0 WHEN 'user_id' THEN 1 "
        "ELSE 2 END, 'Potential outliers detected in ' || column_name || '.' FROM g "
        "WHERE outliers > 0",
        "SELECT 'insight', 10000, 'The event_id ranges from ' || printf('%.2f', mn) || ' to ' || "
        "printf('%.2f', mx) || ' with an average of ' || printf('%.2f', mean) || '.' FROM g "
        "WHERE column_name = 'event_id'",
    ] + [f"SELECT 'recommendation', {i}, '{t}'" for i, t in enumerate(api.RECOMMENDATIONS)] + [
        "SELECT 'visualization', 0, 'Distribution of event_id (bar: event_id vs event_id)'",
        "SELECT 'visualization', 1, 'Relationship between event_id and user_id "
        "(scatter: event_id vs user_id)'",
        "SELECT 'visualization', 2, 'Trend of value over time (line: Time vs value)'",
    ]
    return f"WITH {facts} " + " UNION ALL ".join(lines)


def _dbscan_sql(table: str, key: str, feats: list[str], eps: float, ms: int) -> str:
    """Brute-force DBSCAN: all-pairs neighbours, core counts, components by a
    recursive walk over core-core edges, border = smallest neighbouring cluster."""
    st = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(feats))
    zs = ", ".join(f"CASE WHEN s{i} = 0 THEN 0.0 ELSE ({c} - m{i}) / s{i} END AS z{i}"
                   for i, c in enumerate(feats))
    dist = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(feats)))
    nn = " AND ".join(f"{c} IS NOT NULL" for c in feats)
    return (
        f"WITH RECURSIVE st AS (SELECT {st} FROM {table} WHERE {nn}), "
        f"p AS (SELECT {key} AS id, {zs} FROM {table}, st WHERE {nn}), "
        f"nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON 0.0 + {dist} <= {eps * eps!r}), "
        f"core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {ms}), "
        "ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id), "
        "reach(id, r) AS (SELECT id, id FROM core UNION SELECT reach.id, ce.b FROM reach "
        "JOIN ce ON reach.r = ce.a), "
        "comp AS (SELECT id, min(r) AS lab FROM reach GROUP BY id), "
        "cid AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS cluster "
        "FROM (SELECT DISTINCT lab FROM comp)), "
        "corel AS (SELECT comp.id, cid.cluster FROM comp JOIN cid USING (lab)), "
        "border AS (SELECT nb.a AS id, min(corel.cluster) AS cluster FROM nb JOIN corel "
        "ON nb.b = corel.id WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a) "
        f"SELECT p.id AS {key}, CAST(coalesce(corel.cluster, border.cluster, -1) AS INTEGER) "
        "AS cluster FROM p LEFT JOIN corel ON p.id = corel.id LEFT JOIN border ON p.id = border.id")


_ORACLES: dict[str, str] | None = None


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: statistical insights for every numeric column of ``events``."""
    return q_statistical_insights(spark, SMOKE_DIR)


def _training_data() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and SQL of the training-data operators and their pipeline, where present."""
    found: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    try:
        from tablescope.llm import queries as llm
        found |= llm.QUERIES
        sql |= llm.ORACLE_SQL
        import corpus_pipeline
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as e:
        if (e.name or "").split(".llm")[0] not in ("tablescope", "corpus_pipeline"):
            raise
    except ImportError as e:  # "from tablescope.llm import ..." of a removed folder
        if e.name != "tablescope.llm":
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query key (omitted for invariant-only operators)."""
    global _ORACLES
    if _ORACLES is None:
        import re
        # Same signed-zero normalisation as ``_round`` on the Spark side.
        _ORACLES = {k: re.sub(r"\bround\(", "0.0 + round(", v) for k, v in _oracles().items()}
    return {k: v for k, v in _ORACLES.items() if k in QUERIES} | _training_data()[1]
