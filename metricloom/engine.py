"""The engine: models and sources in, DataFrames and SQL text out."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from metricloom.errors import UnprotectedTable
from metricloom.plans.dialects import dialect_for
from metricloom.plans.frame import allowed, quoted, to_frame
from metricloom.plans.model import Model
from metricloom.plans.request import MAX_LIMIT, Request
from metricloom.plans.resolve import Plan, resolve, table_policies
from metricloom.plans.sqlgen import to_sql
from metricloom.plans.state import StateManager, Stats
from metricloom.sources.registry import SourceRegistry
from metricloom.sources.sinks import envelope

SEMANTIC = "SEMANTIC "
_VERSION = re.compile(r"SELECT\s+VERSION\s*\(\s*\)\s*;?")


class Engine:
    """``user_context``, where one can be given, has the caller's claims; None leaves row policies out."""

    def __init__(self, spark: SparkSession, sources: SourceRegistry | None = None):
        self.spark, self.sources, self.state = spark, sources or SourceRegistry(spark), StateManager()

    def load_yaml(self, text: str) -> Model:
        return self.state.load_yaml(text)

    def load_dir(self, path: str | Path) -> list[Model]:
        return self.state.load_dir(path)

    def stats(self) -> Stats:
        return self.state.stats()

    def plan(self, request: Request | dict, user_context: dict[str, str] | None = None) -> Plan:
        return resolve(Request.of(request), self.state.snapshot(), user_context)

    def query(self, request: Request | dict, user_context: dict[str, str] | None = None) -> DataFrame:
        return to_frame(self.plan(request, user_context), self.sources)

    def compile_sql(self, request: Request | dict, dialect: str = "spark", user_context: dict[str, str] | None = None) -> str:
        return to_sql(self.plan(request, user_context), dialect_for(dialect))

    def rest(self, body: dict, dialect: str = "spark", user_context: dict[str, str] | None = None) -> dict:
        """The answer to a REST body, with real rows: at most MAX_LIMIT of them, and whether there are more."""
        request = Request.from_rest(body)
        plan = self.plan(request, user_context)
        return envelope(request.metric_name, to_sql(plan, dialect_for(dialect)), to_frame(plan, self.sources), MAX_LIMIT)

    def execute(self, text: str, user_context: dict[str, str] | None = None) -> DataFrame | None:
        """``SEMANTIC {json}`` as a request, a client's handshake as such, everything else as Spark SQL over the sources.

        None for what has no rows: blank texts, SET, SHOW, BEGIN, COMMIT. With a user context row policies hold for plain
        SQL too: it must be a query, reads no tables but the sources, and sees of these the rows that the policies let pass.
        """
        body = text.strip()
        if body.startswith(SEMANTIC):
            return self.query(Request.from_json(body[len(SEMANTIC) :]), user_context)
        upper = body.upper()
        if not body or upper.startswith(("SET ", "SHOW ", "BEGIN", "COMMIT")):
            return None
        if _VERSION.fullmatch(upper):
            return self.spark.createDataFrame([(f"metricloom on Spark {self.spark.version}",)], "version string")
        if upper in ("SELECT 1", "SELECT 1;"):
            return self.spark.createDataFrame([(1,)], "`?column?` int")
        body = body.rstrip("; \t\r\n")
        if user_context is not None:
            return self._protected(body, user_context)
        self.sources.create_views()
        return self.spark.sql(body)

    def _protected(self, body: str, claims: dict[str, str]) -> DataFrame:
        """The query with each source hidden by a common table expression of the rows that the claims allow."""
        known = {n.lower(): n for n in self.sources.names() if "." not in n}
        named, inner = _relations(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(body))
        for parts in named:
            name = parts[0].lower()
            if len(parts) > 1 or name not in known and (name not in inner or self.spark.catalog.tableExists(parts[0])):
                raise UnprotectedTable(".".join(parts))
        state, tables = self.state.snapshot(), self.sources.names()
        views: dict[str, str] = {}
        try:
            for name in sorted({parts[0].lower() for parts in named} & set(known)):
                rules = table_policies(state, known[name], tables, claims)
                views[name] = f"__allowed_{uuid.uuid4().hex}"
                rows = self.sources.table(known[name])
                (rows.where(allowed(rules)) if rules else rows).createOrReplaceTempView(views[name])
            hidden = ", ".join(f"{quoted(n)} AS (SELECT * FROM {v})" for n, v in views.items())
            return self.spark.sql((f"WITH {hidden} " if hidden else "") + f"(\n{body}\n)")  # parentheses: nothing but a query parses
        finally:
            for v in views.values():
                self.spark.catalog.dropTempView(v)


#: Parsed nodes without children that plain SQL may have.
_LEAVES = {"UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "UnresolvedTableValuedFunction"}


def _relations(plan) -> tuple[list[list[str]], set[str]]:
    """Of a parsed plan the names of all relations, in subqueries too, and of the common table expressions."""
    named, inner, todo = [], set(), [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            named.append([parts.apply(k) for k in range(parts.size())])
        below, children = node.innerChildren(), node.children()
        if kind not in _LEAVES and (not children.size() or "Identifier" in kind):  # a table in another way, or a name that is computed later
            raise UnprotectedTable(kind)
        more = [below.apply(k) for k in range(below.size())]
        if kind == "UnresolvedWith":
            inner |= {m.alias().lower() for m in more if m.getClass().getSimpleName() == "SubqueryAlias"}
        todo += more + [children.apply(k) for k in range(children.size())]
    return named, inner
