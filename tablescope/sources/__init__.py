"""Sources and sinks: files, Feather, JDBC, JSON result rows."""

from .files import (detect_format, read_table, result_json, scan_csv, scan_json,  # noqa: F401
                    scan_orc, scan_parquet, write_result)
from .jdbc import jdbc_preview, jdbc_query, jdbc_table, jdbc_tables, jdbc_url  # noqa: F401
