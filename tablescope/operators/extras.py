"""Analyses the reference advertises but stubs (X1-X3, X5-X9); X4 lives in stats.

Period aggregates are grouped first (one row per period, partial aggregation
map-side) and only then windowed, so every window runs over a small,
bounded table of periods, never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import as_double, clean_value, numeric_text
from .frames import resolve_columns
from .schema import LOAD_TERMS, coercion_report, dropna_features
from .stats import QUARTILES, column_summary

TRAIN_BUCKETS = 8       # of 10 hash buckets go to training


def _split(df: DataFrame, key: Sequence[str], train: Column | None = None
           ) -> tuple[DataFrame, DataFrame]:
    """Deterministic 80/20 split by a hash of the key (same on any layout), or by ``train``."""
    if train is not None:
        return df.where(train), df.where(~train)
    b = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(10))
    return df.where(b < TRAIN_BUCKETS), df.where(b >= TRAIN_BUCKETS)


def classification(df: DataFrame, label: str, features: Sequence[str], key: Sequence[str],
                   max_iter: int = 300, train: Column | None = None) -> dict[str, DataFrame]:
    """Logistic regression on a hash split; per-class counts and accuracy.

    Classes that occur in the test rows only cannot be predicted; their rows
    are left out.  ``fit`` tells the iterations and whether they converged.
    """
    feats = resolve_columns(df, features)
    data = dropna_features(df.where(F.col(f"`{label}`").isNotNull()), feats)
    learn, test = _split(data, key, train)
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip",
                      stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=feats, outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter)])
    model = pipe.fit(learn)
    pred = model.transform(test)
    classes = model.stages[0].labels
    name = F.element_at(F.lit(list(classes)), F.col("prediction").cast("int") + 1)
    per_class = (pred.groupBy(F.col(f"`{label}`").cast("string").alias("class"))
                 .agg(F.count(F.lit(1)).alias("support"),
                      F.sum((F.col("prediction") == F.col("_y")).cast("int")).alias("correct")))
    acc = pred.agg(F.count(F.lit(1)).alias("test_rows"),
                   F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"))
    steps = model.stages[2].summary.totalIterations
    fit = df.sparkSession.createDataFrame([(int(steps), steps < max_iter)],
                                          "iterations int, converged boolean")
    return {"per_class": per_class, "accuracy": acc, "fit": fit,
            "predictions": pred.select(*key, label, name.alias("predicted"))}


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """X2 (one feature): least-squares slope, intercept, R^2, n in one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    yy, xx = as_double(y, types[y]), as_double(x, types[x])
    return df.agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                  F.regr_r2(yy, xx).alias("r2"), F.regr_count(yy, xx).alias("n"))


def regression(df: DataFrame, y: str, features: Sequence[str], key: Sequence[str],
               train: Column | None = None) -> dict[str, DataFrame]:
    """X2 (many features): linear regression on a hash split, or on the rows of
    ``train``; coefficients and test RMSE."""
    feats = resolve_columns(df, features)
    data = dropna_features(df, [*feats, y])
    learn, test = _split(data, key, train)
    va = VectorAssembler(inputCols=feats, outputCol="_x")
    lr = LinearRegression(featuresCol="_x", labelCol=y).fit(va.transform(learn))
    pred = lr.transform(va.transform(test))
    spark = df.sparkSession
    coef = spark.createDataFrame(
        [(f, float(c)) for f, c in zip(feats, lr.coefficients)] + [("(intercept)",
                                                                   float(lr.intercept))],
        "term string, coefficient double")
    err = pred.agg(F.sqrt(F.avg((F.col("prediction") - F.col(y)) ** 2)).alias("rmse"),
                   F.count(F.lit(1)).alias("test_rows"))
    return {"coefficients": coef, "test_error": err}


def _period(df: DataFrame, ts: str, period: str):
    """Start of the calendar period, keeping a time-zone-free input time-zone free."""
    dt = {f.name: f.dataType for f in df.schema.fields}[ts]
    p = F.date_trunc(period, F.col(f"`{ts}`"))
    return p.cast("timestamp_ntz") if isinstance(dt, T.TimestampNTZType) else p


def ts_periodic(df: DataFrame, ts: str, value: str, period: str = "month") -> DataFrame:
    """``(period, n, total, average)`` per calendar period; NaN counts as missing."""
    p = _period(df, ts, period).alias("period")
    v = clean_value(value, {f.name: f.dataType for f in df.schema.fields}[value])
    return df.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"),
                             F.avg(v).alias("average"))


# Calendar step of each period name.
STEPS = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months",
         "year": "1 year"}


def _calendar(per: DataFrame, period: str) -> DataFrame:
    """Every period from the first to the last; one without rows has a NULL total.

    Rows without a timestamp belong to no period.
    """
    span = per.agg(F.min("period").alias("_lo"), F.max("period").alias("_hi")).where(
        F.col("_lo").isNotNull())
    every = span.select(F.explode(F.expr(
        f"sequence(_lo, _hi, interval {STEPS[period]})")).alias("period"))
    return every.join(per, "period", "left")


def ts_moving_avg(df: DataFrame, ts: str, value: str, period: str = "month",
                  window: int = 3) -> DataFrame:
    """Moving average of period totals over the last ``window`` calendar periods."""
    per = _calendar(ts_periodic(df, ts, value, period), period)
    # One row per period: the un-partitioned window is over a bounded table.
    w = Window.orderBy("period").rowsBetween(-(window - 1), 0)
    return per.select("period", "total", F.avg("total").over(w).alias("moving_avg"))


def ts_trend_forecast(df: DataFrame, ts: str, value: str, period: str = "month",
                      horizon: int = 3) -> DataFrame:
    """Linear trend of period totals against the calendar index; next ``horizon``."""
    per = _calendar(ts_periodic(df, ts, value, period), period)
    w = Window.orderBy("period")
    idx = per.select("period", "total", (F.row_number().over(w) - 1).alias("t"))
    fit = idx.agg(F.regr_slope("total", "t").alias("slope"),
                  F.regr_intercept("total", "t").alias("intercept"),
                  F.max("t").alias("last_t"), F.max("period").alias("last_period"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    unit = {"month": "MONTH", "year": "YEAR", "week": "WEEK", "day": "DAY",
            "quarter": "QUARTER"}[period]
    return fit.select(steps.alias("step"), "slope", "intercept", "last_t", "last_period") \
        .select("step",
                F.expr(f"timestampadd({unit}, step, last_period)").alias("period"),
                (F.col("intercept") + F.col("slope") * (F.col("last_t") + F.col("step")))
                .alias("forecast"))


def _mean(values: Column) -> Column:
    """Mean of an array's non-null values, NULL if there is none."""
    known = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def ts_seasonal_forecast(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (),
                         period: str = "month", season: int = 12, horizon: int = 6,
                         alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2) -> DataFrame:
    """Additive seasonal smoothing of period totals per key: ``(*keys, step, period, forecast)``.

    Level, trend and one seasonal term per position start from the first two
    seasons and follow the recurrence over all later periods of the key's
    calendar.  A period without a total moves the level by the trend and
    changes nothing else.  A key with fewer than two seasons starts at its mean
    with no trend and no seasonal terms.  Rows without a timestamp belong to no
    period; a key without any total has NULL forecasts.  Rows are summed per key
    and period before anything is gathered, so an array holds one number per
    calendar period however many rows a key has.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    v = clean_value(value, {f.name: f.dataType for f in df.schema.fields}[value])
    per = (df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
                     _period(df, ts, period).alias("_p"), v.cast("double").alias("_v"))
           .where(F.col("_p").isNotNull()).groupBy(*names, "_p").agg(F.sum("_v").alias("_y")))
    every = F.expr(f"sequence(min(_p), max(_p), interval {STEPS[period]})")
    blank = per.groupBy(*names).agg(every.alias("_every")).select(
        *names, F.explode("_every").alias("_p"), F.lit(None).cast("double").alias("_y"))
    total = per.unionByName(blank).groupBy(*names, "_p").agg(F.max("_y").alias("_y"))
    series = total.groupBy(*names).agg(
        F.sort_array(F.collect_list(F.struct("_p", "_y")))["_y"].alias("_all"), F.max("_p").alias("_hi")
    ).where(F.col("_hi").isNotNull())
    ys, n = F.col("_all"), F.size("_all")
    first, second = _mean(F.slice(ys, 1, season)), _mean(F.slice(ys, season + 1, season))
    whole = n >= 2 * season
    base = F.coalesce(F.when(whole, first), _mean(ys))
    none = F.array_repeat(F.lit(0.0), season)
    terms = F.when(whole, F.transform(F.slice(ys, 1, season), lambda y: F.coalesce(y - base, F.lit(0.0))))
    start = F.struct(base.alias("level"),
                     F.coalesce(F.when(whole, (second - first) / season), F.lit(0.0)).alias("trend"),
                     F.coalesce(terms, none).alias("terms"))
    weight = F.when(whole, F.lit(gamma)).otherwise(F.lit(0.0))

    def move(state: Column, y: Column) -> Column:
        # The next period's seasonal term comes first; its new value goes to the end.
        term, ahead = state["terms"][0], state["level"] + state["trend"]
        level = F.coalesce(alpha * (y - term) + (1 - alpha) * ahead, ahead)
        trend = F.when(y.isNull(), state["trend"]).otherwise(
            beta * (level - state["level"]) + (1 - beta) * state["trend"])
        fresh = F.coalesce(weight * (y - level) + (1 - weight) * term, term)
        return F.struct(level.alias("level"), trend.alias("trend"),
                        F.concat(F.slice(state["terms"], 2, season - 1), F.array(fresh)).alias("terms"))

    rest = F.when(whole, F.slice(ys, season + 1, F.greatest(n - season, F.lit(1)))).otherwise(ys)
    fitted = series.select(*names, "_hi", F.aggregate(rest, start, move).alias("_s"))
    unit = {"month": "MONTH", "year": "YEAR", "week": "WEEK", "day": "DAY", "quarter": "QUARTER"}[period]
    ahead = fitted.select(*names, "_hi", "_s", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return ahead.select(
        *[F.col(c).alias(k) for k, c in zip(keys, names)], "step",
        F.expr(f"timestampadd({unit}, step, _hi)").alias("period"),
        (F.col("_s.level") + F.col("step") * F.col("_s.trend")
         + F.element_at("_s.terms", F.pmod(F.col("step") - 1, F.lit(season)) + 1)).alias("forecast"))


def revenue_growth(df: DataFrame, ts: str, value: str, period: str = "month") -> DataFrame:
    """Revenue per period and growth rate (%) against the calendar period before."""
    per = _calendar(ts_periodic(df, ts, value, period), period)
    w = Window.orderBy("period")
    prev = F.lag("total").over(w)
    return per.select("period", F.col("total").alias("revenue"),
                      F.when(prev != 0, (F.col("total") - prev) / prev * 100).alias("growth_pct"))


def year_over_year(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Yearly revenue and change against the previous year."""
    g = revenue_growth(df, ts, value, "year")
    return g.select(F.year("period").alias("year"), "revenue",
                    F.col("growth_pct").alias("yoy_pct"))


def avg_transaction(df: DataFrame, ts: str, value: str, period: str = "month") -> DataFrame:
    """Average transaction value per period."""
    return ts_periodic(df, ts, value, period).select("period", "n",
                                                      F.col("average").alias("avg_value"))


def top_segments(df: DataFrame, group: str, segment: str, amount: str,
                 top: int = 3) -> DataFrame:
    """Amount per (group, segment) and its rank within the group, the first ``top``."""
    value = clean_value(amount, {f.name: f.dataType for f in df.schema.fields}[amount])
    seg = df.groupBy(group, segment).agg(F.sum(value).alias("revenue"))
    # One row per (group, segment): the window runs over counted rows only.
    w = Window.partitionBy(group).orderBy(F.desc("revenue"), segment)
    return seg.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= top)


def retention(df: DataFrame, customer: str, ts: str, period: str = "month") -> DataFrame:
    """Share of customers active in a period who are active again next period.

    Rows without a customer or a timestamp are nobody's activity.
    """
    act = df.select(F.col(f"`{customer}`").alias("cust"),
                    _period(df, ts, period).alias("period")).dropna().distinct()
    unit = period.upper()
    nxt = act.select("cust", F.expr(f"timestampadd({unit}, -1, period)").alias("period"),
                     F.lit(1).alias("back"))
    j = act.join(nxt, ["cust", "period"], "left")
    return j.groupBy("period").agg(F.count(F.lit(1)).alias("active"),
                                   F.count("back").alias("retained")).select(
        "period", "active", "retained",
        (F.col("retained") * 100.0 / F.col("active")).alias("retention_pct"))


def clean_table(df: DataFrame, columns: Sequence[str] | None = None,
                approx: bool = False) -> DataFrame:
    """Trim strings, coerce hinted numeric text (P1), impute numeric NULLs with
    the median, clamp values to the 1.5 IQR fences."""
    trimmed = df.withColumns({f.name: F.trim(F.col(f"`{f.name}`")) for f in df.schema.fields
                              if f.dataType.simpleString() == "string"})
    conv = [r["column_name"] for r in coercion_report(trimmed, LOAD_TERMS).where("converted")
            .collect()]
    if conv:
        trimmed = trimmed.withColumns({c: numeric_text(F.col(f"`{c}`")) for c in conv})
    cols = resolve_columns(trimmed, columns)
    if not cols:
        return trimmed
    s = {r["column_name"]: r for r in column_summary(trimmed, cols, QUARTILES, approx=approx)
         .collect()}
    types = {f.name: f.dataType for f in trimmed.schema.fields}
    fixes = {}
    for c in cols:
        r = s[c]
        v = as_double(c, types[c])
        if r["median"] is None:
            continue
        iqr = r["q3"] - r["q1"]
        lo, hi = r["q1"] - 1.5 * iqr, r["q3"] + 1.5 * iqr
        fixes[c] = F.least(F.greatest(F.coalesce(v, F.lit(r["median"])), F.lit(lo)), F.lit(hi))
    return trimmed.withColumns(fixes) if fixes else trimmed
