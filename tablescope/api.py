"""Public API: every operator takes a DataFrame and returns a DataFrame."""

from .operators.distribution import (box_plot, fences, histogram, iqr_outliers,  # noqa: F401
                                     normal_overlay, outlier_counts, qq_line, qq_points,
                                     shapiro_wilk, value_counts, value_counts_all,
                                     value_counts_binned)
from .operators.frames import (approx_quantiles, exact_quantiles, long_form,  # noqa: F401
                               numeric_columns, with_row_index)
from .operators.insights import (RECOMMENDATIONS, chart_suggestions, column_facts,  # noqa: F401
                                 quick_insights,
                                 statistical_insights, statistical_summary)
from .operators.graph import connected_components  # noqa: F401
from .operators.questions import (ask, preview, systematic_sample, systematic_samples,  # noqa: F401
                                  top_n)
from .operators.schema import (PROFILE_TERMS, LOAD_TERMS, classify_columns,  # noqa: F401
                               coerce_numeric, coerce_numeric_profile, coercion_report,
                               column_types, dropna_features)
from .operators.stats import (adjacent_correlations, basic_stats, column_moments,  # noqa: F401
                              column_summary, correlation_matrix, describe_numeric,
                              shared_summaries,
                              dispersion, fingerprint, kurtosis_by_column, missing_report,
                              mode_by_column, profile_columns, question_stats, shape,
                              skewness_by_column)
from .operators.cluster import (cluster_insights, cluster_sizes, clustering_report,  # noqa: F401
                                feature_importance, kmeans, pca_projection, standard_scale)
from .operators.dbscan import dbscan  # noqa: F401
from .operators.extras import (avg_transaction, classification, clean_table,  # noqa: F401
                               linear_fit, regression, retention, revenue_growth, top_segments,
                               ts_moving_avg, ts_periodic, ts_seasonal_forecast, ts_trend_forecast,
                               year_over_year)
from .plans.analyze import analyze, column_charts, run_analysis, statistical, table_context  # noqa: F401
from .plans.sql import run_sql  # noqa: F401
from .session import cut_lineage, get_spark, scratch_folder  # noqa: F401
from .sources.feather import scan_feather, write_feather  # noqa: F401
from .sources.files import (detect_format, read_table, result_json, scan_csv,  # noqa: F401
                            scan_json, write_result)
from .sources.jdbc import (jdbc_preview, jdbc_query, jdbc_table, jdbc_tables,  # noqa: F401
                           jdbc_tables_preview)
