"""Readers with explicit schemas, result writers and the SQL script runner."""

from .blocks import read_array_blocks
from .collections import load_collection, read_collection, read_sessions
from .csv import read_result_csv
from .ragged import union_of_rows, write_ragged
from .ranges import bounds_of, first_ranges, merge_ranges, read_ranges, write_ranges
from .scratch import scratch_path, scratch_scope, stored
from .script import run_sql_script
from .sinks import write_line_items, write_result, write_sessions
from .unique import load_unique, read_unique, set_aside
from . import schemas

__all__ = [
    "bounds_of",
    "first_ranges",
    "load_collection",
    "load_unique",
    "merge_ranges",
    "read_array_blocks",
    "read_collection",
    "read_ranges",
    "read_result_csv",
    "read_sessions",
    "read_unique",
    "run_sql_script",
    "schemas",
    "scratch_path",
    "scratch_scope",
    "set_aside",
    "stored",
    "union_of_rows",
    "write_line_items",
    "write_ragged",
    "write_ranges",
    "write_result",
    "write_sessions",
]
