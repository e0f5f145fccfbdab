"""The pipeline query language: text to syntax tree."""

from .parser import QueryParseError, parse, parse_filter

__all__ = ["QueryParseError", "parse", "parse_filter"]
