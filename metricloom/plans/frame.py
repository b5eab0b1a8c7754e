"""From a plan to a DataFrame. Catalyst does the rest: pruning, pushdown, join order and strategy, partial aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import and_all, date_trunc
from metricloom.sources.registry import SourceRegistry

from .model import Aggregation, JoinType
from .request import FilterOperator
from .resolve import Plan, Predicate

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

AGGREGATES = {
    Aggregation.SUM: F.sum, Aggregation.COUNT: F.count, Aggregation.AVERAGE: F.avg, Aggregation.MIN: F.min, Aggregation.MAX: F.max,
    Aggregation.COUNT_DISTINCT: F.count_distinct,
}
#: How partial results add up; averages keep a sum and a count.
AGAIN = {Aggregation.SUM: F.sum, Aggregation.COUNT: F.sum, Aggregation.MIN: F.min, Aggregation.MAX: F.max}
JOINS = {JoinType.INNER: "inner", JoinType.LEFT: "left", JoinType.FULL: "full"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(entity: str, sql: str) -> Column:
    """A column of an entity, wherever the entity is joined in."""
    return F.col(f"{quoted(entity)}.{quoted(sql if _IDENTIFIER.match(sql) else _computed(sql))}")


def _computed(sql: str) -> str:
    return f"__expr_{sql}"


def condition(p: Predicate, entity: str | None = None) -> Column:
    """A predicate as a Column; without a value it lets nothing pass."""
    if p.value is None:
        return F.lit(False)
    c = column(entity or p.field.entity.name, p.field.dimension.sql)
    if p.operator is FilterOperator.IN:
        return c.isin(*p.value)
    v = F.lit(p.value)
    return {"eq": c == v, "not_eq": c != v, "gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}[p.operator.value]


def allowed(rules: list[Predicate]) -> Column:
    """Row policies as one condition on a bare table."""
    own = lambda sql: F.col(quoted(sql)) if _IDENTIFIER.match(sql) else F.expr(sql)
    return and_all(*(F.lit(False) if p.value is None else own(p.field.dimension.sql) == F.lit(p.value) for p in rules))


class _Builder:
    def __init__(self, plan: Plan, sources: SourceRegistry):
        self.plan, self.sources = plan, sources

    def scan(self, name: str) -> DataFrame:
        """An entity's table under the entity's name, with a column for each expression that the plan needs of it."""
        p, e = self.plan, self.plan.entities[name]
        wanted = [f.dimension.sql for f in (*p.dimensions, *(x.field for x in p.filters), *(x.field for x in p.policies.get(name, ()))) if f.entity.name == name]
        wanted += [p.grain[1].dimension.sql] if p.grain and p.base.name == name else []
        wanted += [p.measure.sql] if p.base.name == name else []
        computed = {_computed(s): F.expr(s) for s in wanted if not _IDENTIFIER.match(s)}
        return self.sources.table(e.table).withColumns(computed).alias(name) if computed else self.sources.table(e.table).alias(name)

    def fact(self, name: str) -> DataFrame:
        """A fact at the grain of its key: its measure's parts if it is the base, else its keys alone."""
        p, key = self.plan, self.plan.keys[name]
        own = [condition(x) for x in (*p.policies.get(name, ()), *(f for f in p.filters if f.field.entity.name == name))]
        rows = self.scan(name)
        rows = rows.where(and_all(*own)) if own else rows
        if name != p.base.name:
            return rows.select(column(name, key).alias(key)).distinct().alias(name)
        value = column(name, p.measure.sql)
        if p.measure.agg is Aggregation.AVERAGE:
            parts = [F.sum(value).alias("__sum"), F.count(value).alias("__count")]
        else:
            parts = [AGGREGATES[p.measure.agg](value).alias("__part")]
        return rows.groupBy(column(name, key).alias(key)).agg(*parts).alias(name)

    def joined(self) -> DataFrame:
        p = self.plan
        take = lambda n: self.fact(n) if n in p.keys else self.scan(n)
        rows, there = take(p.base.name), {p.base.name}
        for h in p.hops:
            if h.right in there:  # a second way to an entity that is there already
                continue
            rows = rows.join(take(h.right), column(h.left, h.left_column) == column(h.right, h.right_column), JOINS[h.type])
            there.add(h.right)
        return rows

    def outer_conditions(self) -> list[Column]:
        p, out = self.plan, []
        for f in p.filters:
            name = f.field.entity.name
            if name not in p.keys:
                out.append(condition(f))
            elif name != p.base.name:  # filtered inside; as a condition on a joined table it also drops what found no row
                out.append(column(name, p.keys[name]).isNotNull())
        out += [condition(x) for name, rules in p.policies.items() if name not in p.keys for x in rules]
        return out

    def measure(self) -> Column:
        p = self.plan
        if p.base.name not in p.keys:
            return AGGREGATES[p.measure.agg](column(p.base.name, p.measure.sql))
        part = lambda c: F.col(f"{quoted(p.base.name)}.{c}")
        if p.measure.agg is Aggregation.AVERAGE:
            return F.sum(part("__sum")) * F.lit(1.0) / F.nullif(F.sum(part("__count")), F.lit(0))
        return AGAIN[p.measure.agg](part("__part"))

    def build(self) -> DataFrame:
        p = self.plan
        rows, outer = self.joined(), self.outer_conditions()
        rows = rows.where(and_all(*outer)) if outer else rows
        by = [date_trunc(p.grain[0], column(p.base.name, p.grain[1].dimension.sql)).alias(p.grain[0])] if p.grain else []
        by += [column(f.entity.name, f.dimension.sql).alias(f.dimension.name) for f in p.dimensions]
        out = self.measure().alias(p.metric)
        rows = rows.groupBy(*by).agg(out) if by else rows.agg(out)
        return rows if p.limit is None else rows.limit(p.limit)


def to_frame(plan: Plan, sources: SourceRegistry) -> DataFrame:
    """Columns: the grain under its own name, the dimensions, the measure under the metric's name."""
    return _Builder(plan, sources).build()


__all__ = ["AGGREGATES", "allowed", "column", "condition", "quoted", "to_frame"]
