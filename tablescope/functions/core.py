"""Column expressions shared by every operator.

All of these stay inside Catalyst (no Python UDFs): missing-value
normalisation (C1), the pandas-compatible numeric parse (C3), bias-corrected
moments (C5), guarded correlation (C8) and display formatting (C4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The numeric-text grammar accepted by pandas.to_numeric
# (blanks, sign, ".5", "5.", exponent, inf/infinity in any case).
NUMERIC_TEXT_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def is_numeric_type(dt: T.DataType) -> bool:
    """Spark numeric types (booleans are not numbers, as in pandas)."""
    return isinstance(dt, T.NumericType)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def clean_value(name: str, dt: T.DataType) -> Column:
    """Column ``name`` with NaN mapped to NULL (one notion of missing)."""
    c = F.col(f"`{name}`")
    if is_float_type(dt):
        return F.when(~F.isnan(c), c)
    return c


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric column as double with NaN -> NULL."""
    c = F.col(f"`{name}`").cast("double")
    if is_float_type(dt):
        return F.when(~F.isnan(c), c)
    return c


def normalize_missing(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float/double column; +-inf stay values."""
    fixes = {f.name: clean_value(f.name, f.dataType)
             for f in df.schema.fields if is_float_type(f.dataType)}
    return df.withColumns(fixes) if fixes else df


def numeric_text(c: Column) -> Column:
    """Parse text to double following the pandas grammar (NULL if it fails)."""
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_TEXT_PATTERN), F.trim(s).try_cast("double"))


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness G1 from population skewness g1 (pandas .skew()).

    NULL for n < 3; 0 for a constant column (Spark yields NULL there).
    """
    nd = n.cast("double")
    corr = F.sqrt(nd * (nd - 1)) / (nd - 2)
    return F.when(n >= 3, F.coalesce(g1 * corr, F.lit(0.0)))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas .kurtosis()); NULL for n < 4."""
    nd = n.cast("double")
    val = (nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6)
    return F.when(n >= 4, F.when(g2.isNull(), F.lit(0.0)).otherwise(val))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL (not an error) for a constant side."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def truncate_text(c: Column, width: int = 20) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("...")))\
        .otherwise(s)
