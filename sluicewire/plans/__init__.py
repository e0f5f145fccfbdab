"""Queries to DataFrames."""

from .compiler import compile_query, query
from .payload import to_json_lines, to_payload

__all__ = ["compile_query", "query", "to_json_lines", "to_payload"]
