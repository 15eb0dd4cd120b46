"""Preview, top-N, systematic sample and the keyword question rules.

Top-N and preview are ``TakeOrderedAndProject`` (bounded per task).  The
systematic sample selects its ranks by :func:`frames.rows_at_steps`, which sorts
only the buckets that hold one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import clean_value
from .frames import numeric_columns, rows_at_steps, with_row_index
from .stats import question_stats


def _cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{c}`") if isinstance(c, str) else c for c in order_by]


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str | Column] | None = None
            ) -> DataFrame:
    """L1: first ``n`` rows (deterministic when ``order_by`` is a unique key)."""
    return (df.orderBy(*_cols(order_by)) if order_by else df).limit(n)


def top_n(df: DataFrame, n: int, by: str, tiebreak: Sequence[str | Column] = ()) -> DataFrame:
    """L2: sort descending by ``by`` (NaN/NULL last), first ``n`` rows."""
    dt = {f.name: f.dataType for f in df.schema.fields}[by]
    key = clean_value(by, dt)
    return df.orderBy(key.desc_nulls_last(), *_cols(tiebreak)).limit(n)


# Name hints for point labels (L4) and the label formats:
#   "Row {i}: {column} = {value:,.2f}, {label_column} = {label}"  (with a label column)
#   "Row {i}: {value:,.2f}"                                        (without)
LABEL_TERMS = ["id", "name", "key", "title"]


def systematic_samples(df: DataFrame, columns: Sequence[str], order_by: Sequence[str | Column],
                       m: int = 100) -> DataFrame:
    """L3/L4 for many columns: ``(column_name, idx, value, label)``.

    Every ``n // m``-th row of the table (first ``m``), NULL values dropped;
    ``idx`` is the 0-based row position in ``order_by`` order, found once for
    all columns.  Small tables (n <= m) give every row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    label_col = next((c for c in df.columns if any(t in c.lower() for t in LABEL_TERMS)), None)
    keep = [F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)]
    keep += [F.col(f"`{label_col}`").cast("string").alias("_label")] if label_col else []
    order = _cols(order_by)
    rows = df.select(*keep, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    names, n = [f"_o{i}" for i in range(len(order))], df.count()
    picked = with_row_index(rows, names, "idx") if n <= m else rows_at_steps(rows, names, n // m, m, n)
    values = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.coalesce(clean_value(f"_v{i}", types[c]).cast("double")).alias("value"))
        for i, c in enumerate(columns)])).alias("_s")
    rows = picked.select("idx", values, *(["_label"] if label_col else [])).select(
        "idx", "_s.*", *(["_label"] if label_col else [])).where(F.col("value").isNotNull())
    if label_col:
        label = F.concat(F.format_string("Row %d: %s = ", F.col("idx"), F.col("column_name")),
                         F.format_number("value", 2), F.lit(f", {label_col} = "), F.col("_label"))
    else:
        label = F.format_string("Row %d: %s", F.col("idx"), F.format_number("value", 2))
    return rows.select("column_name", "idx", "value", label.alias("label"))


def systematic_sample(df: DataFrame, column: str, order_by: Sequence[str | Column],
                      m: int = 100) -> DataFrame:
    """L3/L4 for one column: ``(idx, value, label)``."""
    return systematic_samples(df, [column], order_by, m).drop("column_name")


@dataclass
class Answer:
    kind: str          # 'top', 'stats' or 'preview'
    message: str
    frame: DataFrame


# Question keywords and answer messages of D5 ({name} = value).
STAT_WORDS = ["average", "mean", "median", "max", "min", "sum"]
ANSWERS = {
    "top": "Showing top {n} records sorted by {column}",
    "stats": "Calculated statistics for {columns}",
    "preview": "Here's a sample of the data. Please ask a more specific question.",
}


def ask(df: DataFrame, text: str, order_by: Sequence[str | Column] = ()) -> Answer:
    """Answer a keyword question with a top-N, per-column stats or a preview.

    Rules (first hit wins, on the lower-cased text): "top N" with a numeric
    column -> top N by the first column named in the text, else the first
    numeric column; any of average/mean/median/max/min/sum -> statistics of
    the named columns (else all numeric; non-numeric ones are skipped);
    otherwise the first 10 rows.
    """
    low = text.lower()
    num = numeric_columns(df)
    m = re.search(r"\btop\s+(\d+)", low)
    if "top" in low and m and num:
        n = int(m.group(1))
        sort_col = next((c for c in df.columns if c.lower() in low), num[0])
        return Answer("top", ANSWERS["top"].format(n=n, column=sort_col),
                      top_n(df, n, sort_col, order_by))
    if any(w in low for w in STAT_WORDS):
        targets = [c for c in df.columns if c.lower() in low] or num
        stats_cols = [c for c in targets if c in num]
        msg = ANSWERS["stats"].format(columns=", ".join(targets))
        if not stats_cols:
            spark = df.sparkSession
            return Answer("stats", msg, spark.createDataFrame(
                [], "column_name string, mean double, median double, min double, "
                    "max double, sum double"))
        return Answer("stats", msg, question_stats(df, stats_cols))
    return Answer("preview", ANSWERS["preview"],
                  preview(df, 10, order_by or None))
