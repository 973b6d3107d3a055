"""Readers and writers."""

from .benchmark import evaluation_lines, scan_benchmark, write_benchmark
from .result_files import decode, parse_results_tolerant, scan_result_files
from .sinks import write_csv, write_csv_per_metric, write_result_payloads, write_sample_details
from .task_lists import normalize_task_spec, scan_task_list

__all__ = [
    "decode",
    "evaluation_lines",
    "normalize_task_spec",
    "parse_results_tolerant",
    "scan_benchmark",
    "scan_result_files",
    "scan_task_list",
    "write_benchmark",
    "write_csv",
    "write_csv_per_metric",
    "write_result_payloads",
    "write_sample_details",
]
