"""How each warehouse spells what a plan needs."""

from __future__ import annotations

import re

from metricloom.errors import DialectError

from .resolve import GRAINS, Value


class Dialect:
    """ANSI spelling."""

    name = "ansi"
    quote, escaped = '"', '""'

    def identifier(self, name: str) -> str:
        """One segment."""
        return self.quote + name.replace(self.quote, self.escaped) + self.quote

    def qualified(self, name: str) -> str:
        """Segments between dots, each quoted."""
        return ".".join(map(self.identifier, name.split(".")))

    def literal(self, value: Value) -> str:
        if isinstance(value, tuple):
            return "(" + ", ".join(map(self.literal, value)) + ")"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, int | float):
            return repr(value)
        return "'" + value.replace("'", "''") + "'"

    def date_trunc(self, grain: str, column: str) -> str:
        return f"DATE_TRUNC('{self._grain(grain)}', {column})"

    @staticmethod
    def _grain(grain: str) -> str:
        if grain.lower() not in GRAINS:
            raise DialectError(f"unknown time granularity '{grain}'")
        return grain.lower()

    def cast(self, expression: str, kind: str) -> str:
        return f"CAST({expression} AS {kind})"

    def json_path(self, column: str, path: str) -> str:
        raise DialectError(f"{self.name} has no JSON paths")

    def unnest(self, expression: str) -> str:
        raise DialectError(f"{self.name} has no UNNEST of columns")

    def aggregate(self, agg: str, expression: str) -> str:
        if agg == "count_distinct":
            return f"COUNT(DISTINCT {expression})"
        return f"{'AVG' if agg == 'average' else agg.upper()}({expression})"

    count_star = "COUNT(*)"

    def order(self, keys: list[tuple[str, bool]], limit: int | None = None, offset: int | None = None) -> str:
        """The tail of a query: (column, descending) keys, limit and offset."""
        parts = ["ORDER BY " + ", ".join(f"{self.qualified(c)} {'DESC' if down else 'ASC'}" for c, down in keys)] if keys else []
        parts += [f"{word} {n}" for word, n in (("LIMIT", limit), ("OFFSET", offset)) if n is not None]
        return " ".join(parts)


class Postgres(Dialect):
    name = "postgres"

    def cast(self, expression: str, kind: str) -> str:
        return f"{expression}::{kind}"


class Snowflake(Dialect):
    name = "snowflake"

    def identifier(self, name: str) -> str:
        return super().identifier(name.upper())

    def date_trunc(self, grain: str, column: str) -> str:
        return f"DATE_TRUNC('{self._grain(grain).upper()}', {column})"

    def json_path(self, column: str, path: str) -> str:
        return f"GET_PATH({column}, {self.literal(path)})"


class BigQuery(Dialect):
    name = "bigquery"
    quote, escaped = "`", "\\`"

    def date_trunc(self, grain: str, column: str) -> str:
        return f"DATE_TRUNC({column}, {self._grain(grain).upper()})"

    def json_path(self, column: str, path: str) -> str:
        return f"JSON_EXTRACT_SCALAR({column}, {self.literal('$.' + path)})"

    def unnest(self, expression: str) -> str:
        return f"UNNEST({expression})"


class Spark(Dialect):
    name = "spark"
    quote, escaped = "`", "``"

    def literal(self, value: Value) -> str:
        return super().literal(value.replace("\\", "\\\\").replace("'", "\\'")).replace("\\''", "\\'") if isinstance(value, str) else super().literal(value)

    def json_path(self, column: str, path: str) -> str:
        return f"GET_JSON_OBJECT({column}, {self.literal('$.' + path)})"

    def unnest(self, expression: str) -> str:
        return f"EXPLODE({expression})"

    def cast(self, expression: str, kind: str) -> str:
        return f"CAST({expression} AS {kind})"


_KINDS = {d.name: d for d in (Dialect, Postgres, Snowflake, BigQuery, Spark)}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def dialect_for(kind: str, strict: bool = False) -> Dialect:
    """The dialect of that name; unknown ones are Postgres unless ``strict``."""
    if strict and kind.lower() not in _KINDS:
        raise DialectError(f"unknown dialect '{kind}'")
    return _KINDS.get(kind.lower(), Postgres)()
