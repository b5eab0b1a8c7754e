"""What callers outside Spark get: text rows and the REST envelope."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_text_rows(df: DataFrame) -> DataFrame:
    """Every column as text named col_0, col_1, ...; null as ``NULL``, bytes as ``<bytes>``, booleans as true and false."""
    out = []
    for k, f in enumerate(df.schema.fields):
        column = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)
        text = F.when(column.isNotNull(), "<bytes>") if isinstance(f.dataType, T.BinaryType) else F.to_json(column) if nested else column.cast("string")
        out.append(F.coalesce(text, F.lit("NULL")).alias(f"col_{k}"))
    return df.select(*out)


def _plain(value: object) -> object:
    return value if value is None or isinstance(value, bool | int | float | str) else float(value) if isinstance(value, Decimal) else str(value)


def envelope(metric: str, sql: str, df: DataFrame, limit: int) -> dict:
    """The REST answer, with the rows themselves: at most ``limit`` of them; ``truncated`` says whether there are more."""
    rows = [[_plain(v) for v in r] for r in df.limit(limit + 1).collect()]
    return {"metric": metric, "sql": sql, "columns": df.columns, "rows": rows[:limit], "row_count": min(len(rows), limit), "truncated": len(rows) > limit}
