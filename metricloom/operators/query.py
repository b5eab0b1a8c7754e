"""A query put together clause by clause, where a request is too narrow: any expressions, HAVING, ORDER BY, LIMIT, OFFSET."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.errors import DialectError
from metricloom.functions import and_all
from metricloom.plans.model import JoinType


def count_star() -> Column:
    return F.count(F.lit(1))


def raw(sql: str) -> Column:
    """An expression as Spark SQL text; never from a caller's input."""
    return F.expr(sql)


def time_spine(spark: SparkSession, grain: str, first: str, last: str) -> DataFrame:
    """One row for each start of a grain from ``first`` to ``last``, both included: column ``time_spine``."""
    units = {"year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days", "day": "1 day", "hour": "1 hour", "minute": "1 minute", "second": "1 second"}
    if grain.lower() not in units:
        raise DialectError(f"unknown time granularity '{grain}'")
    ends = [F.date_trunc(grain.lower(), F.lit(x).cast("timestamp_ntz")).cast("timestamp_ntz") for x in (first, last)]
    return spark.range(1).select(F.explode(F.sequence(*ends, F.expr(f"interval {units[grain.lower()]}"))).alias("time_spine"))


@dataclass(frozen=True)
class Query:
    """Clauses in the order that SQL evaluates them. Null keys sort last ascending and first descending, as in Postgres."""

    source: DataFrame
    conditions: tuple[Column, ...] = ()
    keys: tuple[Column, ...] = ()
    measures: tuple[Column, ...] = ()
    columns: tuple[Column, ...] = ()
    group_conditions: tuple[Column, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    most: int | None = None
    skip: int | None = None

    @classmethod
    def of(cls, source: DataFrame | Query, alias: str | None = None) -> Query:
        """From a table, or from another query (a CTE or a subquery)."""
        rows = source.frame() if isinstance(source, Query) else source
        return cls(rows.alias(alias) if alias else rows)

    def join(self, other: DataFrame | Query, on: Column, kind: JoinType | str = JoinType.LEFT) -> Query:
        rows = other.frame() if isinstance(other, Query) else other
        return replace(self, source=self.source.join(rows, on, JoinType(kind).value))

    def select(self, *columns: Column) -> Query:
        return replace(self, columns=columns)

    def where(self, *conditions: Column) -> Query:
        return replace(self, conditions=self.conditions + conditions)

    def group_by(self, *keys: Column) -> Query:
        return replace(self, keys=keys)

    def agg(self, *measures: Column) -> Query:
        return replace(self, measures=measures)

    def having(self, *conditions: Column) -> Query:
        """Conditions on the names that the keys and measures have."""
        return replace(self, group_conditions=self.group_conditions + conditions)

    def order_by(self, *keys: str | tuple[str, str]) -> Query:
        """Names of output columns, or (name, "asc" or "desc")."""
        return replace(self, orders=tuple((k, False) if isinstance(k, str) else (k[0], k[1].lower() == "desc") for k in keys))

    def limit(self, n: int | None) -> Query:
        return replace(self, most=n)

    def offset(self, n: int | None) -> Query:
        return replace(self, skip=n)

    def with_pagination(self, orders: tuple = (), limit: int | None = None, offset: int | None = None) -> Query:
        return self.order_by(*orders).limit(limit).offset(offset)

    def frame(self) -> DataFrame:
        rows = self.source.where(and_all(*self.conditions)) if self.conditions else self.source
        if self.measures:
            rows = rows.groupBy(*self.keys).agg(*self.measures) if self.keys else rows.agg(*self.measures)
        elif self.keys:
            rows = rows.select(*self.keys).distinct()
        if self.group_conditions:
            rows = rows.where(and_all(*self.group_conditions))
        if self.columns:
            rows = rows.select(*self.columns)
        if self.orders:
            rows = rows.orderBy(*(F.desc_nulls_first(c) if down else F.asc_nulls_last(c) for c, down in self.orders))
        if self.skip:
            rows = rows.offset(self.skip)
        return rows if self.most is None else rows.limit(self.most)
