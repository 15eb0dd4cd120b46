"""Analysis dispatch (D1-D4, D6): named analyses return named DataFrames.

Nothing is evaluated here beyond the small per-column summaries operators
need to build their plans; each returned DataFrame is an unevaluated plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators import cluster, distribution, extras, insights, questions, schema, stats
from ..operators.frames import numeric_columns



class LazyResults(Mapping):
    """Named results built on first access (building some of them runs small
    summary jobs, so unused outputs cost nothing).  All of them share one
    summary scope, so moments and quantiles are computed once per column."""

    def __init__(self, parts: dict[str, object]):
        self._parts = dict(parts)
        self._summaries: dict = {}

    def __getitem__(self, key: str) -> object:
        value = self._parts[key]
        if callable(value):
            with stats.shared_summaries(self._summaries):
                value = self._parts[key] = value()
        return value

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


KINDS = ("quick_ai", "clustering", "statistical", "custom", "classification", "regression",
         "time_series")


def analyze(df: DataFrame, kind: str, **params) -> Mapping[str, object]:
    """Run one analysis kind; unknown kinds raise ``ValueError``."""
    if kind == "quick_ai":
        return {"insights": insights.quick_insights(df, params.get("query")),
                "charts": insights.chart_suggestions(df),
                "correlations": stats.adjacent_correlations(df)}
    if kind == "clustering":
        return cluster.clustering_report(
            df, params.get("features"), params.get("algorithm", "kmeans"),
            params.get("num_clusters", 3), params.get("eps", 0.5), params.get("min_samples", 5),
            keep=params.get("keep", ()), order_by=params.get("order_by"))
    if kind == "statistical":
        return statistical(df, params.get("column"), approx=params.get("approx", False))
    if kind == "custom":
        return {"statistics": stats.describe_numeric(df), "column_types": schema.column_types(df),
                "sample": questions.preview(df, 5, params.get("order_by"))}
    if kind == "classification":
        return _with_model(df, "Classification analysis", params, ("label", "features", "key"),
                           lambda: extras.classification(df, params["label"], params["features"],
                                                         params["key"]))
    if kind == "regression":
        return _with_model(df, "Regression analysis", params, ("target", "features", "key"),
                           lambda: extras.regression(df, params["target"], params["features"],
                                                     params["key"]))
    if kind == "time_series":
        return _with_model(df, "Time series analysis", params, ("ts", "value"),
                           lambda: {"periods": extras.ts_periodic(df, params["ts"], params["value"]),
                                    "forecast": extras.ts_trend_forecast(
                                        df, params["ts"], params["value"])})
    raise ValueError(f"Unknown analysis type: {kind}")


def run_analysis(df: DataFrame, kind: str, **params) -> dict[str, object]:
    """An analysis with its status record; a failure is recorded, not raised.

    ``{"status": "completed", "results": ...}`` or
    ``{"status": "failed", "error_message": ..., "results": {}}``.  Results that
    are built later raise their own errors when they are read.
    """
    try:
        return {"analysis_type": kind, "status": "completed", "error_message": None,
                "results": analyze(df, kind, **params)}
    except Exception as e:  # noqa: BLE001 - the record is the point
        return {"analysis_type": kind, "status": "failed", "error_message": str(e), "results": {}}


def _with_model(df: DataFrame, title: str, params: dict, needed: tuple[str, ...],
                run: Callable[[], dict]) -> dict[str, object]:
    """Without parameters only a message and a 5-row preview, as in the
    reference; with them the model is fitted.  Parameters are checked first."""
    sample = {"sample": questions.preview(df, 5, params.get("order_by"))}
    if not any(params.get(p) for p in needed):
        return {"message": f"{title} would be performed here", **sample}
    missing = [p for p in needed if not params.get(p)]
    if missing:
        raise ValueError(f"{title} needs: {', '.join(missing)}")
    for p in needed:
        for c in [params[p]] if isinstance(params[p], str) else params[p]:
            if c not in df.columns:
                raise ValueError(f"Column {c} not found in dataset")
    return {"message": f"{title} performed", **sample, **run()}


def statistical(df: DataFrame, column: str | None = None, approx: bool = False
                ) -> Mapping[str, object]:
    """D3: the statistical analysis of one numeric column (default: the first)."""
    num = numeric_columns(df)
    if not num:
        raise ValueError("No numeric column available for analysis")
    col = column or num[0]
    cols = [col]
    return LazyResults({
        "column": col,
        "other_numeric_columns": [c for c in num if c != col],
        "basic_stats": lambda: stats.describe_numeric(df, cols, approx),
        "formatted_stats": lambda: stats.basic_stats(df, cols, approx),
        "dispersion": lambda: stats.dispersion(df, cols, approx),
        "skewness": lambda: stats.skewness_by_column(df, cols),
        "kurtosis": lambda: stats.kurtosis_by_column(df, cols),
        "mode": lambda: stats.mode_by_column(df, cols),
        "value_counts": lambda: distribution.value_counts_binned(df, col),
        "histogram": lambda: distribution.histogram(df, cols, 20),
        "normal_overlay": lambda: distribution.normal_overlay(df, col),
        "box_plot": lambda: distribution.box_plot(df, cols, approx),
        "outliers": lambda: distribution.iqr_outliers(df, cols, approx=approx),
        "normality": lambda: distribution.shapiro_wilk(df, cols),
        "qq_points": lambda: distribution.qq_points(df, cols),
        "qq_line": lambda: distribution.qq_line(df, cols),
        "insights": lambda: insights.statistical_insights(df, cols, approx),
        "summary": lambda: insights.statistical_summary(df, cols, approx),
    })


def column_charts(df: DataFrame, column: str | None = None,
                  order_by: Sequence[str] | None = None) -> dict[str, object]:
    """Value counts, 10-bin histogram and systematic sample for every numeric
    column (after the profile-time coercion), plus the selected column."""
    coerced = schema.coerce_numeric_profile(df)
    num = numeric_columns(coerced)
    if not num:
        return {"numeric_columns": [], "selected_column": None}
    sel = column if column in num else num[0]
    with stats.shared_summaries():
        out: dict[str, object] = {
            "numeric_columns": num, "selected_column": sel,
            "value_counts": distribution.value_counts_all(coerced, num),
            "histogram": distribution.histogram(coerced, num, 10),
        }
        if order_by:
            out["samples"] = questions.systematic_samples(coerced, num, order_by)
    return out


def table_context(df: DataFrame, order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Five sample rows, numeric description and per-column profile."""
    with stats.shared_summaries():
        return {"sample": questions.preview(df, 5, order_by),
                "describe": stats.describe_numeric(df),
                "profile": stats.profile_columns(df)}
