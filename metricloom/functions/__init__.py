"""Scalar and aggregate functions as Columns."""

from .scalars import and_all, cast_as, combine_eq, date_trunc, function_call, json_path, literal_bool, literal_num, literal_str, null_if, or_any, unnest

__all__ = ["and_all", "cast_as", "combine_eq", "date_trunc", "function_call", "json_path", "literal_bool", "literal_num", "literal_str", "null_if", "or_any", "unnest"]
