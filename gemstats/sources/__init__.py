"""Sources and sinks: the synthetic diamond view and file formats."""

from .files import NA_TOKENS, read_table, write_csv, write_parquet
from .fixture import RAW_COLUMNS, diamond_raw, diamond_raw_from, table

__all__ = ["NA_TOKENS", "RAW_COLUMNS", "diamond_raw", "diamond_raw_from", "read_table",
           "table", "write_csv", "write_parquet"]
