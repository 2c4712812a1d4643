"""Sources and sinks: typed file scans, SQL over views, stored web pages."""

from .files import read_csv, read_table, write_csv, write_parquet
from .sql import run_sql, rows_to_frame

__all__ = ["read_csv", "read_table", "write_csv", "write_parquet", "run_sql",
           "rows_to_frame"]
