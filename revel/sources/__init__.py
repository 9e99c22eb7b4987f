"""Sources and sinks (readers, writers and fixture views over the driver tables)."""

from revel.sources.readers import (
    bad_lines,
    good_lines,
    read_csv,
    read_explanations,
    read_json_array,
    read_json_lines,
    read_report,
    read_run_log,
)
from revel.sources.sinks import write_csv, write_json_array, write_parquet, write_report

__all__ = [
    "bad_lines", "good_lines", "read_csv", "read_explanations", "read_json_array", "read_json_lines",
    "read_report", "read_run_log", "write_csv", "write_json_array", "write_parquet", "write_report",
]
