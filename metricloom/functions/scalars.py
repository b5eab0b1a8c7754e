"""Scalar functions: built-in Columns with the checks that Spark leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.errors import DialectError
from metricloom.plans.resolve import GRAINS, boolean, number

#: Other names of Spark's types.
TYPE_NAMES = {"text": "string", "varchar": "string", "int8": "bigint", "int4": "int", "int2": "smallint", "integer": "int", "float8": "double", "float4": "float", "double precision": "double", "numeric": "decimal(38,9)", "bool": "boolean", "bytea": "binary", "timestamptz": "timestamp"}


def date_trunc(grain: str, column: Column) -> Column:
    """The start of the year, quarter, month, week (Monday), day, hour, minute or second, as a timestamp without zone."""
    if grain.lower() not in GRAINS:
        raise DialectError(f"unknown time granularity '{grain}'")
    return F.date_trunc(grain.lower(), column.cast("timestamp_ntz")).cast("timestamp_ntz")


def cast_as(column: Column, kind: str) -> Column:
    return column.cast(TYPE_NAMES.get(kind.strip().lower(), kind))


def json_path(column: Column, path: str) -> Column:
    """The scalar at a path such as ``a.b`` of a JSON string, as a string; null if there is none."""
    return F.get_json_object(column, path if path.startswith("$") else f"$.{path}")


def unnest(column: Column) -> Column:
    return F.explode(column)


def null_if(column: Column, value: Column) -> Column:
    return F.nullif(column, value)


def function_call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def and_all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if not conditions else reduce(lambda a, b: a & b, conditions)


def or_any(*conditions: Column) -> Column:
    return F.lit(False) if not conditions else reduce(lambda a, b: a | b, conditions)


def combine_eq(left: Column, right: Column) -> Column:
    return left == right


def literal_str(text: str) -> Column:
    return F.lit(text)


def literal_num(text: str) -> Column | None:
    """A whole or finite number; None if the text isn't one."""
    value = number(text)
    return None if value is None else F.lit(value)


def literal_bool(text: str) -> Column | None:
    value = boolean(text)
    return None if value is None else F.lit(value)
