"""Distribution operators.

Every operator reads the data in at most two passes: a bounded one-row-per-
column summary (see :func:`stats.column_summary`) and one pass that uses the
summary as a broadcast (a handful of rows, one per column).  Binning is pure
column arithmetic; empty bins come from a generated bin sequence, not from a
join against the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import as_double, safe_corr
from ..functions.normal import lower_tail_sql, pdf_sql, ppf_sql
from .frames import (KEY, VALUE, distinct_counts, long_form, native_value_counts, resolve_columns,
                     with_row_index)
from .stats import QUARTILES, column_summary

IQR_FACTOR = 1.5


def fences(df: DataFrame, columns: Sequence[str] | None = None,
           approx: bool = False) -> DataFrame:
    """``(column_name, n, q1, median, q3, lower, upper)`` per numeric column."""
    s = column_summary(df, columns, QUARTILES, approx=approx)
    iqr = F.col("q3") - F.col("q1")
    return s.select(KEY, "n", "rows", "min", "max", "mean", "std", "sum", "skewness",
                    "kurtosis", "q1", "median", "q3",
                    (F.col("q1") - IQR_FACTOR * iqr).alias("lower"),
                    (F.col("q3") + IQR_FACTOR * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None,
                 ids: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Rows whose value lies strictly outside the 1.5 IQR fences.

    Long output ``(*ids, column_name, v)``; NULL never matches.
    """
    cols = resolve_columns(df, columns)
    f = fences(df, cols, approx=approx).select(KEY, "lower", "upper")
    lf = long_form(df, cols, ids)
    # One row per column: a safe broadcast.
    return (lf.join(F.broadcast(f), KEY)
            .where((F.col(VALUE) < F.col("lower")) | (F.col(VALUE) > F.col("upper")))
            .select(*ids, KEY, VALUE))


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None,
                   approx: bool = False) -> DataFrame:
    """Outlier count per column with fences: ``(column_name, lower, upper, outliers)``."""
    cols = resolve_columns(df, columns)
    f = fences(df, cols, approx=approx)
    types = {x.name: x.dataType for x in df.schema.fields}
    bounds = {r[KEY]: (r["lower"], r["upper"]) for r in f.select(KEY, "lower", "upper")
              .collect()}
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = bounds[c]
        v = as_double(c, types[c])
        cond = (v < F.lit(lo)) | (v > F.lit(hi)) if lo is not None else F.lit(False)
        aggs.append(F.count(F.when(cond, 1)).alias(f"o{i}"))
    # One row per column, read back like the summary it extends.
    row = df.agg(*aggs).first()
    counts = df.sparkSession.createDataFrame(
        [(c, row[f"o{i}"]) for i, c in enumerate(cols)], f"{KEY} string, outliers long")
    return f.join(counts, KEY)


def box_plot(df: DataFrame, columns: Sequence[str] | None = None,
             approx: bool = False) -> DataFrame:
    """Five-number summary plus outlier count; outliers via :func:`iqr_outliers`."""
    oc = outlier_counts(df, columns, approx=approx)
    return oc.select(KEY, "min", "q1", "median", "q3", "max",
                     F.col("outliers").alias("outlier_count"))


# -- value counts -----------------------------------------------------------

def _number_label(v):
    """Label of A11: integral numbers with thousands separators, else ``{:,.2f}``."""
    return (F.when(v == F.floor(v), F.format_number(v, 0))
            .otherwise(F.format_number(v, 2)))


def value_counts(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Counts per value, NULLs dropped, ordered by value ascending, first ``limit``.

    ``TakeOrderedAndProject`` keeps ``limit`` rows per task, so the top-k never
    gathers the column.
    """
    dt = {f.name: f.dataType for f in df.schema.fields}[column]
    from ..functions.core import clean_value, is_numeric_type, truncate_text
    v = clean_value(column, dt)
    counts = (df.select(v.alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count(F.lit(1)).alias("count")))
    label = (_number_label(F.col("value").cast("double")) if is_numeric_type(dt)
             else truncate_text(F.col("value")))
    return counts.orderBy("value").limit(limit).withColumn("label", label)


def value_counts_all(df: DataFrame, columns: Sequence[str] | None = None,
                     limit: int = 20) -> DataFrame:
    """A11 for many numeric columns: ``(column_name, v, value_text, count)``.

    Values are counted in their own type; ``value_text`` is the exact value.
    One scan serves all columns: the ranks are taken over the counted values,
    and each task keeps only the first ``limit`` per column before the shuffle.
    """
    first = Window.partitionBy(KEY).orderBy(VALUE, "exact")
    return (native_value_counts(df, columns).withColumn("_n", F.row_number().over(first))
            .where(F.col("_n") <= limit)
            .select(KEY, VALUE, F.col("text").alias("value_text"), F.col("cnt").alias("count")))


def _edges(lo, width, nbins, i):
    """numpy.linspace edge i: ``i * step + start``, last edge pinned to stop."""
    return F.when(i >= nbins, lo + width).otherwise(i * (width / nbins) + lo)


def _numpy_bin(v, lo, hi, nbins: int):
    """Bin index of numpy.histogram (left-closed, last bin closed)."""
    width = hi - lo
    # A range too small to divide has all values in one bin.
    k0 = F.least(F.floor(F.try_divide(v - lo, width) * nbins), F.lit(nbins - 1)).cast("int")
    e_k = F.when(k0 >= nbins, hi).otherwise(k0 * (width / nbins) + lo)
    e_k1 = F.when(k0 + 1 >= nbins, hi).otherwise((k0 + 1) * (width / nbins) + lo)
    return (F.when(v < e_k, k0 - 1)
            .when((v >= e_k1) & (k0 < nbins - 1), k0 + 1).otherwise(k0))


def _ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, n, min, max)``, one row per column, without higher moments."""
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [as_double(c, types[c]) for c in cols]
    wide = df.agg(*[f(v).alias(f"{name}{i}") for i, v in enumerate(values)
                    for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias(KEY), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("min"),
        F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)])))


def histogram(df: DataFrame, columns: Sequence[str] | str | None = None,
              bins: int = 10) -> DataFrame:
    """Numpy-compatible equal-width histogram per numeric column.

    ``(column_name, bin, lower, upper, count, label)``; empty bins are kept;
    a constant column uses the range [v-0.5, v+0.5]; no values, or an infinite
    one, give one bin [0, 1] with count 0.
    """
    cols = resolve_columns(df, columns)
    summ = _ranges(df, cols)
    none = (F.col("n") == 0) | (F.abs("min") == float("inf")) | (F.abs("max") == float("inf"))
    rng = summ.select(
        KEY,
        F.when(none, F.lit(0.0)).when(F.col("min") == F.col("max"),
                                                 F.col("min") - 0.5).otherwise(F.col("min"))
        .alias("_lo"),
        F.when(none, F.lit(1.0)).when(F.col("min") == F.col("max"),
                                                 F.col("max") + 0.5).otherwise(F.col("max"))
        .alias("_hi"),
        F.when(none, F.lit(1)).otherwise(F.lit(bins)).alias("_nb"), none.alias("_none"))
    lf = long_form(df, cols).where(F.col(VALUE).isNotNull())
    binned = (lf.join(F.broadcast(rng.where(~F.col("_none"))), KEY)
              .select(KEY, _numpy_bin(F.col(VALUE), F.col("_lo"), F.col("_hi"), bins)
                      .alias("bin"))
              .groupBy(KEY, "bin").agg(F.count(F.lit(1)).alias("count")))
    width = F.col("_hi") - F.col("_lo")
    all_bins = rng.select(KEY, "_lo", "_hi", "_nb",
                          F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("bin"))
    out = (all_bins.join(binned, [KEY, "bin"], "left")
           .select(KEY, "bin",
                   _edges(F.col("_lo"), width, F.col("_nb"), F.col("bin")).alias("lower"),
                   _edges(F.col("_lo"), width, F.col("_nb"), F.col("bin") + 1).alias("upper"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))
    return out.withColumn("label", histogram_label(F.col("lower"), F.col("upper")))


# Histogram bin labels (A13) by bin width: both edges integral ->
# "{lo:,} - {hi:,}"; width > 10 -> "%.0f - %.0f"; width > 1 -> "%.1f - %.1f";
# else "%.2f - %.2f".  Binned value counts (A12): "{left:.1f}-{right:.1f}".
# Value-count labels (A11): integral numbers "{:,}", others "{:,.2f}", text cut at 20
# characters plus "...".
def histogram_label(lo, hi):
    """Label rule of A13 by edge magnitude."""
    integral = (lo == F.floor(lo)) & (hi == F.floor(hi))
    w = F.abs(hi - lo)
    return (F.when(integral, F.concat(F.format_number(lo, 0), F.lit(" - "),
                                      F.format_number(hi, 0)))
            .when(w > 10, F.format_string("%.0f - %.0f", lo, hi))
            .when(w > 1, F.format_string("%.1f - %.1f", lo, hi))
            .otherwise(F.format_string("%.2f - %.2f", lo, hi)))


def _few_values(values: DataFrame, most: int) -> tuple[list[float] | None, float | None, float | None]:
    """The distinct values of a column when there are at most ``most``, else None; least and greatest value.

    One pass: a task stops gathering beyond ``most`` values and sends one row.
    """
    import numpy as np
    import pyarrow as pa

    def look(batches):
        seen, low, high = set(), None, None
        for batch in batches:
            a = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            low = float(a.min()) if low is None else min(low, float(a.min()))
            high = float(a.max()) if high is None else max(high, float(a.max()))
            if len(seen) <= most:
                seen.update(np.unique(a)[:most + 1].tolist())
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(seen)[:most + 1]], pa.list_(pa.float64())), pa.array([low]), pa.array([high])],
                                             names=["seen", "low", "high"])

    rows = values.mapInArrow(look, "seen array<double>, low double, high double").collect()
    if not rows:
        return [], None, None
    every = set().union(*[r["seen"] for r in rows])
    return (sorted(every) if len(every) <= most else None), min(r["low"] for r in rows), max(r["high"] for r in rows)


def value_counts_binned(df: DataFrame, column: str, max_distinct: int = 15,
                        bins: int = 10) -> DataFrame:
    """Plain value counts if <= 15 distinct values, else pandas ``cut`` into 10
    right-closed equal-width bins (first edge lowered by 0.1 % of the range).

    ``(bin, lower, upper, count, label)``; for plain counts lower = upper = value.
    Two passes: few values and range, then counts by value or bin, combined map-side.
    """
    cols = resolve_columns(df, [column])
    lf = long_form(df, cols).where(F.col(VALUE).isNotNull()).select((F.col(VALUE) + 0.0).alias(VALUE))
    values, mn, mx = _few_values(lf, max_distinct)
    if values is not None:
        # At most ``max_distinct`` rows: the global window is bounded.
        return lf.groupBy(VALUE).agg(F.count(F.lit(1)).alias("cnt")).select(
            (F.dense_rank().over(Window.orderBy(VALUE)) - 1).cast("int").alias("bin"),
            F.col(VALUE).alias("lower"), F.col(VALUE).alias("upper"),
            F.col("cnt").alias("count"), F.col(VALUE).cast("string").alias("label"))
    step = (mx - mn) / bins
    adj = (mx - mn) * 0.001
    v = F.col(VALUE)
    # Fixed-value edges e_i = i * step + min (numpy.linspace), e_0 lowered.
    def edge(i):
        return (F.when(i <= 0, F.lit(mn - adj)).when(i >= bins, F.lit(mx))
                .otherwise(i * F.lit(step) + F.lit(mn)))
    m0 = F.greatest(F.ceil((v - F.lit(mn)) / F.lit(mx - mn) * bins) - 1, F.lit(0)).cast("int")
    m0 = F.least(m0, F.lit(bins - 1))
    m = (F.when(v > edge(m0 + 1), m0 + 1)
         .when((v <= edge(m0)) & (m0 > 0), m0 - 1).otherwise(m0))
    counted = lf.groupBy(m.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(counted, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return out.withColumn("label", F.format_string("%.1f-%.1f", "lower", "upper"))


def normal_overlay(df: DataFrame, column: str, points: int = 100,
                   bins: int = 20) -> DataFrame:
    """A14 overlay: ``pdf(x; mean, std) * n * (max - min) / bins`` on ``points`` x values."""
    st = column_summary(df, [column], {}).collect()[0]
    mn, mx, mean, std, n = st["min"], st["max"], st["mean"], st["std"], st["n"]
    idx = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    if mn is None:
        return idx.select("i", F.lit(None).cast("double").alias("x"),
                          F.lit(None).cast("double").alias("y"))
    step = (mx - mn) / (points - 1)
    x = F.when(F.col("i") == points - 1, F.lit(mx)).otherwise(F.col("i") * F.lit(step) + F.lit(mn))
    pts = idx.select("i", x.alias("x"))
    std_sql = "NULL" if std is None else format(std, ".17e")
    y = (F.expr(pdf_sql("x", format(mean, ".17e"), std_sql)) * F.lit(n) * F.lit(mx - mn) / bins)
    return pts.select("i", "x", y.alias("y"))


# -- QQ plot and Shapiro-Wilk ------------------------------------------------

def _filliben(i, n):
    """Filliben order-statistic medians (as scipy ``probplot``)."""
    nd = n.cast("double")
    last = F.pow(F.lit(0.5), 1.0 / nd)
    return (F.when(i == n, last).when(i == 1, 1 - last)
            .otherwise((i - 0.3175) / (nd + 0.365)))


def _ranked(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-column 1-based rank of the sorted non-null values, via global index."""
    s = column_summary(df, cols, {})
    # The random tiebreak lets the range partitioner split a value shared by
    # many rows (a hot value) across tasks; tied rows carry the same sample
    # value, so their order does not change the output.
    lf = (long_form(df, cols).where(F.col(VALUE).isNotNull())
          .withColumn("_tb", F.rand(17)))
    ordered = with_row_index(lf, [KEY, VALUE, "_tb"], name="_g").drop("_tb")
    # Column offsets: one row per column.
    offs = s.select(KEY, "n", F.coalesce(F.sum("n").over(
        Window.orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    ranked = ordered.join(F.broadcast(offs), KEY).select(
        KEY, VALUE, "n", (F.col("_g") - F.col("_off") + 1).alias("i"))
    return ranked, s


def qq_points(df: DataFrame, columns: Sequence[str] | str | None = None) -> DataFrame:
    """``(column_name, i, theoretical, sample)`` for every non-null value."""
    cols = resolve_columns(df, columns)
    ranked, _ = _ranked(df, cols)
    return ranked.select(KEY, "i", _filliben(F.col("i"), F.col("n")).alias("_m"),
                         F.col(VALUE).alias("sample")).select(
        KEY, "i", F.expr(ppf_sql("_m")).alias("theoretical"), "sample")


def qq_line(df: DataFrame, columns: Sequence[str] | str | None = None) -> DataFrame:
    """Least-squares slope/intercept of sample on theoretical quantiles."""
    pts = qq_points(df, columns)
    return pts.groupBy(KEY).agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        safe_corr(F.col("theoretical"), F.col("sample")).alias("r"))


# Shapiro-Wilk size limit, significance level and labels.
SW_MAX_N = 5000
SW_ALPHA = 0.05
SW_LABELS = ("Normal distribution", "Non-normal distribution", "Not tested")


def shapiro_wilk(df: DataFrame, columns: Sequence[str] | str | None = None,
                 max_n: int = SW_MAX_N) -> DataFrame:
    """Shapiro-Wilk W and p-value (Royston 1995) per column with 3 <= n < 5000.

    The test holds for samples below ``max_n`` values (5000, as in the reference)
    that are not constant; other columns get NULL and the label "Not tested".
    Only tested columns are ranked, so every window group is bounded.
    """
    cols = resolve_columns(df, columns)
    s = column_summary(df, cols, {})
    small = [r[KEY] for r in s.select(KEY, "n", "min", "max").collect()
             if r["n"] is not None and 3 <= r["n"] < max_n and r["min"] != r["max"]]
    res = None
    if small:
        lf = long_form(df, small).where(F.col(VALUE).isNotNull())
        w = Window.partitionBy(KEY).orderBy(VALUE)
        r = (lf.select(KEY, VALUE, F.row_number().over(w).alias("i"),
                       F.count(F.lit(1)).over(Window.partitionBy(KEY)).alias("n"))
             .withColumn("_p", (F.col("i") - 0.375) / (F.col("n") + 0.25))
             .withColumn("m", F.expr(ppf_sql("_p"))))
        agg = r.groupBy(KEY).agg(
            F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("_msum"),
            F.max(F.when(F.col("i") == F.col("n"), F.col("m"))).alias("m_n"),
            F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("m_n1"),
            F.avg(VALUE).alias("mean"))
        u = 1.0 / F.sqrt(F.col("n").cast("double"))
        # Royston (1995) polynomial coefficients.
        a_n = (F.col("m_n") / F.sqrt("_msum") + 0.221157 * u - 0.147981 * u ** 2
               - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5)
        a_n1 = (F.col("m_n1") / F.sqrt("_msum") + 0.042981 * u - 0.293762 * u ** 2
                - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5)
        eps_big = ((F.col("_msum") - 2 * F.col("m_n") ** 2 - 2 * F.col("m_n1") ** 2)
                   / (1 - 2 * F.col("a_n") ** 2 - 2 * F.col("a_n1") ** 2))
        eps_small = (F.col("_msum") - 2 * F.col("m_n") ** 2) / (1 - 2 * F.col("a_n") ** 2)
        coef = agg.withColumns({"a_n": a_n, "a_n1": a_n1}).withColumn(
            "eps", F.when(F.col("n") > 5, eps_big).otherwise(eps_small))
        i, n = F.col("i"), F.col("n")
        a_i = (F.when(n == 3, F.when(i == 1, -F.sqrt(F.lit(0.5))).when(i == 3, F.sqrt(F.lit(0.5)))
                      .otherwise(F.lit(0.0)))
               .when(i == n, F.col("a_n")).when(i == 1, -F.col("a_n"))
               .when((n > 5) & (i == n - 1), F.col("a_n1"))
               .when((n > 5) & (i == 2), -F.col("a_n1"))
               .otherwise(F.col("m") / F.sqrt("eps")))
        # One row per small column: safe broadcast.
        j = r.drop("n").join(F.broadcast(coef), KEY)
        ww = j.groupBy(KEY).agg(
            F.first("n").alias("n"),
            F.sum(a_i * F.col(VALUE)).alias("_num"),
            F.sum((F.col(VALUE) - F.col("mean")) ** 2).alias("_ss"))
        ww = ww.withColumn("W", F.least(F.lit(1.0), F.col("_num") ** 2 / F.col("_ss")))
        nd = F.col("n").cast("double")
        L = F.log(nd)
        gamma = 0.459 * nd - 2.273
        mu_small = 0.5440 - 0.39978 * nd + 0.025054 * nd ** 2 - 0.0006714 * nd ** 3
        sg_small = F.exp(1.3822 - 0.77857 * nd + 0.062767 * nd ** 2 - 0.0020322 * nd ** 3)
        mu_big = -1.5861 - 0.31082 * L - 0.083751 * L ** 2 + 0.0038915 * L ** 3
        sg_big = F.exp(-0.4803 - 0.082676 * L + 0.0030302 * L ** 2)
        z = (F.when(nd <= 11, (-F.log(gamma - F.log(1 - F.col("W"))) - mu_small) / sg_small)
             .otherwise((F.log(1 - F.col("W")) - mu_big) / sg_big))
        ww = ww.withColumn("_z", z)
        tail = lower_tail_sql("_z")
        upper = F.expr(f"CASE WHEN _z > 0 THEN {tail} ELSE 1e0 - {tail} END")
        p3 = F.greatest(F.lit(0.0), 6 / 3.141592653589793 * (
            F.asin(F.sqrt("W")) - F.asin(F.sqrt(F.lit(0.75)))))
        res = ww.select(KEY, "W", F.when(F.col("n") == 3, p3).otherwise(
            F.when(F.col("W") >= 1, F.lit(1.0)).otherwise(upper)).alias("p_value"))
    base = s.select(KEY, "n")
    out = base.join(res, KEY, "left") if res is not None else base.withColumns(
        {"W": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")})
    p = F.col("p_value")
    return out.select(KEY, "n", "W", "p_value", F.when(p.isNull(), SW_LABELS[2])
                      .when(p > SW_ALPHA, SW_LABELS[0]).otherwise(SW_LABELS[1])
                      .alias("interpretation"))
