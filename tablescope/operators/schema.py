"""Schema repair and classification.

Parse ratios of many candidate columns are computed in ONE aggregate; the
decision (a few booleans per column) is the only thing read back by the
driver, and the conversion itself is a lazy ``withColumns``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import clean_value, is_numeric_type, numeric_text
from .frames import KEY

# Column-name hints of the load-time coercion.
LOAD_TERMS = ["order", "number", "num", "qty", "price", "amount", "sales", "id"]
# Column-name hints of the profile-time coercion.
PROFILE_TERMS = ["number", "num", "count", "qty", "price", "amount", "sales", "order", "id",
                 "revenue", "profit"]
# Name hints of the column classifier.
CLASSIFY_TERMS = ["order", "number", "num", "qty", "quantity", "price", "amount", "sales", "id"]
DATE_TERMS = ["date", "time"]


def _has_term(name: str, terms: Sequence[str]) -> bool:
    low = name.lower()
    return any(t in low for t in terms)


def coercion_report(df: DataFrame, terms: Sequence[str] = LOAD_TERMS, threshold: float = 0.8,
                    inclusive: bool = False) -> DataFrame:
    """Parse ratio of every string column whose name has a hint term.

    ``(column_name, parse_ratio, converted)``; the ratio's denominator is all
    rows, NULLs included.  Only string columns are candidates (dates and
    booleans are never turned into numbers).
    """
    cands = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and _has_term(f.name, terms)]
    spark = df.sparkSession
    if not cands:
        return spark.createDataFrame([], f"{KEY} string, parse_ratio double, converted boolean")
    agg = df.agg(*[F.avg(numeric_text(F.col(f"`{c}`")).isNotNull().cast("double"))
                   .alias(f"r{i}") for i, c in enumerate(cands)])
    rows = agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(KEY), F.col(f"r{i}").alias("parse_ratio"))
        for i, c in enumerate(cands)])))
    ratio = F.col("parse_ratio")
    ok = (ratio >= threshold) if inclusive else (ratio > threshold)
    return rows.withColumn("converted", F.coalesce(ok, F.lit(False)))


def coerce_numeric(df: DataFrame, terms: Sequence[str] = LOAD_TERMS, threshold: float = 0.8,
                   inclusive: bool = False) -> DataFrame:
    """Replace hinted string columns that mostly parse by their numeric value."""
    report = coercion_report(df, terms, threshold, inclusive)
    convert = [r[KEY] for r in report.where("converted").select(KEY).collect()]
    if not convert:
        return df
    return df.withColumns({c: numeric_text(F.col(f"`{c}`")) for c in convert})


def coerce_numeric_profile(df: DataFrame) -> DataFrame:
    """P2 parameters: profile term list, ratio ``>= 0.8``."""
    return coerce_numeric(df, PROFILE_TERMS, 0.8, inclusive=True)


def column_types(df: DataFrame) -> DataFrame:
    """``(position, column_name, dtype)``."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        f"position int, {KEY} string, dtype string")


def classify_columns(df: DataFrame, order_by: Sequence[str | Column] | None = None,
                     sample: int | None = None) -> DataFrame:
    """``(position, column_name, type, category)`` with category numeric/date/text.

    Numeric by type, or by a name hint when more than 80 % of the non-null
    values parse; one aggregate serves all columns.  With ``sample`` only the
    first that many non-null values in ``order_by`` order count.
    """
    if sample is not None and not order_by:
        raise ValueError("a sample needs order_by")
    fields = df.schema.fields
    spark = df.sparkSession
    cands = [f.name for f in fields if not is_numeric_type(f.dataType)
             and not isinstance(f.dataType, T.BooleanType)
             and _has_term(f.name, CLASSIFY_TERMS)]
    ratios: dict[str, float] = {}
    for group in ([cands] if sample is None else [[c] for c in cands]):
        if not group:
            continue
        base = df
        if sample is not None:
            base = df.where(F.col(f"`{group[0]}`").isNotNull()).orderBy(*order_by).limit(sample)
        row = base.agg(*[F.avg(F.when(F.col(f"`{c}`").isNotNull(), numeric_text(
            F.col(f"`{c}`").cast("string")).isNotNull().cast("double"))).alias(f"r{i}")
            for i, c in enumerate(group)]).first()
        ratios.update({c: row[f"r{i}"] for i, c in enumerate(group)})
    rows = []
    for i, f in enumerate(fields):
        dtype = f.dataType.simpleString()
        if is_numeric_type(f.dataType):
            rows.append((i, f.name, dtype, "numeric"))
        elif (ratios.get(f.name) or 0.0) > 0.8:
            rows.append((i, f.name, "numeric", "numeric"))
        elif (isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
              or _has_term(f.name, DATE_TERMS)):
            rows.append((i, f.name, "datetime", "date"))
        else:
            rows.append((i, f.name, "text", "text"))
    return spark.createDataFrame(rows, f"position int, {KEY} string, type string, "
                                       "category string")


def dropna_features(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """P5: drop rows with a NULL/NaN in any feature column."""
    from .frames import resolve_columns
    feats = resolve_columns(df, features)
    types = {f.name: f.dataType for f in df.schema.fields}
    cond = F.lit(True)
    for c in feats:
        cond = cond & clean_value(c, types[c]).isNotNull()
    return df.where(cond)
