"""Rule-based insights.

Numbers are computed once per column (bounded summary rows); rules are
``when`` expressions producing an array of structs that is exploded, so the
rule engine is plain Catalyst over a table with one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distribution import outlier_counts, shapiro_wilk
from .frames import KEY, date_columns, numeric_columns, resolve_columns, text_columns
from .stats import missing_report, shape



def column_facts(df: DataFrame, columns: Sequence[str] | None = None,
                 approx: bool = False) -> DataFrame:
    """One row per numeric column with every number the rules need."""
    oc = outlier_counts(df, columns, approx=approx)
    return oc.select(
        KEY, "n", "rows", "mean", "std", "min", "max", "q1", "median", "q3", "lower", "upper",
        "outliers", "skewness", "kurtosis",
        (F.col("rows") - F.col("n")).alias("missing"),
        F.when(F.col("rows") > 0, (F.col("rows") - F.col("n")) * 100.0 / F.col("rows"))
        .alias("missing_pct"),
        F.when(F.col("n") > 0, F.col("outliers") * 100.0 / F.col("n")).alias("outlier_pct"),
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100).alias("cv"))


# ---------------------------------------------------------------------------
# Thresholds of the insight rules.
NORMAL_BELOW = 0.5            # |skewness| and |kurtosis| below: normal
NON_NORMAL_ABOVE = 1.0        # |skewness| or |kurtosis| above: non-normal
TRANSFORM_SKEW_ABOVE = 1.5    # |skewness| above: suggest a transformation
OUTLIER_WARNING_ABOVE = 2     # outlier % above: warning, else info
OUTLIER_SIGNIFICANT_ABOVE = 5  # outlier % effect: significant / moderate / minimal
OUTLIER_MODERATE_ABOVE = 1
MISSING_SEVERE_ABOVE = 15     # missing %: severe (danger) / moderate (warning) / minor (info)
MISSING_MODERATE_ABOVE = 5
CV_HIGH_ABOVE = 30            # coefficient of variation %
CV_LOW_BELOW = 5
SHAPE_KURTOSIS_ABOVE = 1.5

# Insight titles and message templates ({name} = computed value).
TEXT = {
    "normal": ("Normal Distribution",
               "The distribution of {column} appears to be approximately normal (skewness: "
               "{skew}, kurtosis: {kurt}), making it suitable for parametric statistical tests."),
    "non_normal": ("Non-Normal Distribution",
                   "The distribution of {column} deviates significantly from normal (skewness: "
                   "{skew}, kurtosis: {kurt}). Consider using non-parametric tests or "
                   "transforming the data."),
    "transformation": ("Transformation Suggestion",
                       "Due to the high skewness ({skew}), consider applying a {transform} to "
                       "normalize the data."),
    "outliers": ("Outliers Detected",
                 "Found {count} outliers ({pct}% of data) which may have a {effect} effect on "
                 "your analysis."),
    "missing": ("Missing Values",
                "This column has {count} missing values ({pct}% of data), which represents a "
                "{severity} data quality issue. Consider imputation or filtering strategies."),
    "high_cv": ("High Variability",
                "The coefficient of variation is {cv}%, indicating high data variability. This "
                "may suggest heterogeneity in your data."),
    "low_cv": ("Low Variability",
               "The coefficient of variation is only {cv}%, indicating low data variability. "
               "This may suggest homogeneity in your data."),
    "shape": ("Distribution Shape",
              "The distribution is {peak} than a normal distribution with {tails}."),
}
TRANSFORMS = ("log transformation", "square transformation")          # skew > 0 / < 0
PEAKS = ("more peaked (leptokurtic)", "more flat (platykurtic)")        # kurtosis > 0 / < 0
TAILS = ("heavier tails", "lighter tails")
# ---------------------------------------------------------------------------


def _render(template: str, **values) -> "F.Column":
    """``format_string`` for a template with ``{name}`` placeholders."""
    import re
    names = re.findall(r"\{(\w+)\}", template)
    fmt = re.sub(r"\{\w+\}", "%s", template.replace("%", "%%"))
    return F.format_string(fmt, *[values[n].cast("string") for n in names])


def _rule(cond, rule, level, key, metric, **values):
    title, template = TEXT[key]
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), level.alias("severity"),
                                 F.lit(title).alias("title"),
                                 _render(template, **values).alias("message"),
                                 metric.cast("double").alias("metric")))


def statistical_insights(df: DataFrame, columns: Sequence[str] | None = None,
                         approx: bool = False) -> DataFrame:
    """``(column_name, rule, severity, title, message, metric)`` (rules C12)."""
    f = column_facts(df, columns, approx)
    c = F.col(KEY)
    sk, ku = F.col("skewness"), F.col("kurtosis")
    s3, k3 = F.format_string("%.3f", sk), F.format_string("%.3f", ku)
    normal = (F.abs(sk) < NORMAL_BELOW) & (F.abs(ku) < NORMAL_BELOW)
    non_normal = ~normal & ((F.abs(sk) > NON_NORMAL_ABOVE) | (F.abs(ku) > NON_NORMAL_ABOVE))
    op, mp, cv = F.col("outlier_pct"), F.col("missing_pct"), F.col("cv")
    two = lambda x: F.format_string("%.2f", x)
    rules = [
        _rule(normal, "normality", F.lit("success"), "normal", sk, column=c, skew=s3, kurt=k3),
        _rule(non_normal, "normality", F.lit("warning"), "non_normal", sk,
              column=c, skew=s3, kurt=k3),
        _rule(non_normal & (F.abs(sk) > TRANSFORM_SKEW_ABOVE), "transformation", F.lit("info"),
              "transformation", sk, skew=s3,
              transform=F.when(sk > 0, TRANSFORMS[0]).otherwise(TRANSFORMS[1])),
        _rule(F.col("outliers") > 0, "outliers",
              F.when(op > OUTLIER_WARNING_ABOVE, "warning").otherwise("info"), "outliers", op,
              count=F.col("outliers"), pct=two(op),
              effect=F.when(op > OUTLIER_SIGNIFICANT_ABOVE, "significant")
              .when(op > OUTLIER_MODERATE_ABOVE, "moderate").otherwise("minimal")),
        _rule(F.col("missing") > 0, "missing",
              F.when(mp > MISSING_SEVERE_ABOVE, "danger")
              .when(mp > MISSING_MODERATE_ABOVE, "warning").otherwise("info"), "missing", mp,
              count=F.col("missing"), pct=two(mp),
              severity=F.when(mp > MISSING_SEVERE_ABOVE, "severe")
              .when(mp > MISSING_MODERATE_ABOVE, "moderate").otherwise("minor")),
        _rule(cv > CV_HIGH_ABOVE, "variability", F.lit("info"), "high_cv", cv, cv=two(cv)),
        _rule(cv < CV_LOW_BELOW, "variability", F.lit("info"), "low_cv", cv, cv=two(cv)),
        _rule(F.abs(ku) > SHAPE_KURTOSIS_ABOVE, "shape", F.lit("info"), "shape", ku,
              peak=F.when(ku > 0, PEAKS[0]).otherwise(PEAKS[1]),
              tails=F.when(ku > 0, TAILS[0]).otherwise(TAILS[1])),
    ]
    arr = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return f.select(KEY, F.inline(arr))


def statistical_summary(df: DataFrame, columns: Sequence[str] | None = None,
                        approx: bool = False) -> DataFrame:
    """I6 flattened: distribution type, central tendency, dispersion, data quality."""
    from .stats import mode_by_column, shared_summaries
    cols = resolve_columns(df, columns)
    with shared_summaries():
        f = column_facts(df, cols, approx)
        sw = shapiro_wilk(df, cols).select(KEY, F.col("interpretation")
                                           .alias("distribution_type"))
    mode = mode_by_column(df, cols)
    return (f.join(sw, KEY).join(mode, KEY, "left")
            .select(KEY, "distribution_type", "mean", "median", "mode",
                    (F.col("max") - F.col("min")).alias("range"), "std",
                    (F.col("q3") - F.col("q1")).alias("iqr"),
                    F.col("cv").alias("coefficient_of_variation"),
                    F.col("missing").alias("missing_values"), "missing_pct",
                    F.col("outliers").alias("outlier_count"), "outlier_pct"))


# Quick-insight sentences of I2 ({name} = computed value).
QUICK = {
    "shape": "The dataset contains {rows} rows and {columns} columns.",
    "key_columns": "Key columns for analysis include: {names}.",
    "numeric": "Numeric columns: {names}.",
    "text": "Text columns: {names}.",
    "dates": "Date columns: {names}.",
    "missing": "Columns with missing values: {items}.",
    "missing_item": "{column} ({pct}% missing)",
    "outliers": "Potential outliers detected in {column}.",
    "range": "The {column} ranges from {min} to {max} with an average of {mean}.",
    "question": "To answer your specific question about '{query}', additional targeted "
                "analysis may be needed.",
}
NO_COLUMNS = "None"

# Recommendation sentences of I4.
RECOMMENDATIONS = [
    "Consider running a more detailed statistical analysis on the key numeric variables.",
    "Explore the relationships between variables with correlation analysis.",
    "Clean any missing or outlier values for more accurate results.",
]


def _names(cols: list[str]) -> str:
    return ", ".join(cols) if cols else NO_COLUMNS


def quick_insights(df: DataFrame, query: str | None = None, approx: bool = False) -> DataFrame:
    """I2 + I4 + I5: ``(section, seq, text)`` lines describing the table.

    Column lists come from the schema; the numbers (row count, missing
    percentages, outlier flags, range of the first numeric column) come from
    bounded per-column aggregates.
    """
    from .stats import shared_summaries
    with shared_summaries():
        return _quick_insights(df, query, approx)


def _quick_insights(df: DataFrame, query: str | None, approx: bool) -> DataFrame:
    spark = df.sparkSession
    num, txt, dat = numeric_columns(df), text_columns(df), date_columns(df)
    cols = list(df.columns)
    sh = shape(df)
    lines = sh.select(F.inline(F.array(
        F.struct(F.lit(0).alias("seq"), _render(QUICK["shape"], rows=F.col("rows"),
                                                 columns=F.col("columns")).alias("text")),
        *[F.struct(F.lit(i).alias("seq"), F.lit(QUICK[k].format(names=v)).alias("text"))
          for i, k, v in [(1, "key_columns", ", ".join(cols[:3])), (2, "numeric", _names(num)),
                          (3, "text", _names(txt)), (4, "dates", _names(dat))]]))).select(
        F.lit("insight").alias("section"), "seq", "text")
    miss = missing_report(df).select(
        _render(QUICK["missing_item"], column=F.col(KEY),
                pct=F.format_string("%.1f", "pct_missing")).alias("item"), KEY)
    # One row per column with missing values: bounded by the schema width.
    order = {c: i for i, c in enumerate(cols)}
    order_df = spark.createDataFrame(list(order.items()), f"{KEY} string, pos int")
    miss_line = (miss.join(F.broadcast(order_df), KEY)
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                     F.struct("pos", "item"))), lambda x: x["item"]), ", ").alias("items"),
                      F.count(F.lit(1)).alias("k"))
                 .where(F.col("k") > 0)
                 .select(F.lit("insight").alias("section"), F.lit(5).alias("seq"),
                         _render(QUICK["missing"], items=F.col("items")).alias("text")))
    parts = [lines, miss_line]
    if num:
        oc = outlier_counts(df, num, approx=approx)
        pos = {c: i for i, c in enumerate(num)}
        pos_df = spark.createDataFrame(list(pos.items()), f"{KEY} string, pos int")
        parts.append(oc.where(F.col("outliers") > 0).join(F.broadcast(pos_df), KEY).select(
            F.lit("insight").alias("section"), (F.lit(100) + F.col("pos")).alias("seq"),
            _render(QUICK["outliers"], column=F.col(KEY)).alias("text")))
        first = oc.where(F.col(KEY) == num[0])
        parts.append(first.select(
            F.lit("insight").alias("section"), F.lit(10000).alias("seq"),
            _render(QUICK["range"], column=F.col(KEY), min=F.format_string("%.2f", "min"),
                    max=F.format_string("%.2f", "max"),
                    mean=F.format_string("%.2f", "mean")).alias("text")))
    recs = RECOMMENDATIONS + ([QUICK["question"].format(query=query)] if query else [])
    static = [("recommendation", i, t) for i, t in enumerate(recs)]
    static += [("visualization", i, t) for i, t in enumerate(_chart_lines(cols, num))]
    parts.append(spark.createDataFrame(static, "section string, seq int, text string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chart_suggestions(df: DataFrame) -> DataFrame:
    """``(title, type, x_axis, y_axis)`` from the schema."""
    cols, num = list(df.columns), numeric_columns(df)
    return df.sparkSession.createDataFrame(_charts(cols, num),
                                           "title string, type string, x_axis string, "
                                           "y_axis string")


# Suggested charts (I5): numeric columns needed, title, type, x axis, y axis.
# {0}, {1}, {2} are numeric columns in order, {first} is the table's first column.
CHART_RULES = (
    (1, "Distribution of {0}", "bar", "{first}", "{0}"),
    (2, "Relationship between {0} and {1}", "scatter", "{0}", "{1}"),
    (3, "Trend of {2} over time", "line", "Time", "{2}"),
)


def _charts(cols: list[str], num: list[str]) -> list[tuple[str, ...]]:
    return [tuple(text.format(*num, first=cols[0]) for text in texts)
            for needed, *texts in CHART_RULES if len(num) >= needed]


def _chart_lines(cols: list[str], num: list[str]) -> list[str]:
    return [f"{t} ({k}: {x} vs {y})" for t, k, x, y in _charts(cols, num)]
