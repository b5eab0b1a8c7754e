import itertools
from decimal import Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

import __spark_entry__
from metricloom import errors as E
from metricloom.engine import Engine
from metricloom.plans import catalogue
from metricloom.sources import to_text_rows

CHASM = """
name: shop
entities:
  - {name: customers, table: public.customers, primary_key: customer_id, entity_type: dimension, dimensions: [{name: region, type: string, sql: region}, {name: vip, type: boolean, sql: vip}], measures: [], rls_policies: []}
  - {name: orders, table: public.orders, primary_key: id, dimensions: [{name: order_status, type: string, sql: status}, {name: ordered, type: time, sql: ordered}], measures: [{name: amount, agg: AGG, sql: amount}]}
  - {name: returns, table: public.returns, primary_key: id, dimensions: [{name: return_id, type: number, sql: id}, {name: return_customer_id, type: number, sql: customer_id}], measures: []}
joins:
  - {left_entity: orders, left_column: customer_id, right_entity: customers, right_column: customer_id}
  - {left_entity: customers, left_column: customer_id, right_entity: returns, right_column: customer_id}
metrics:
  - {name: by_region, measure: amount, dimensions: [region, return_customer_id]}
  - {name: plain, measure: amount, dimensions: [region]}
"""

ORDERS = [(1, 1, 10.0, "a"), (2, 1, 30.0, "a"), (3, 2, None, "b"), (4, None, 7.0, "b"), (5, 9, 5.0, "b"), (6, 3, 2.0, "a")]
RETURNS = [(1, 1), (2, 1), (3, 3), (4, None)]
CUSTOMERS = [(1, "n", True), (2, "n", False), (3, "s", None), (4, "s", True)]


def shop(spark, agg="sum", orders=ORDERS, returns=RETURNS, text=CHASM):
    e = Engine(spark)
    e.load_yaml(text.replace("AGG", agg))
    e.sources.register("orders", spark.createDataFrame(orders, "id long, customer_id long, amount double, status string").selectExpr("*", "timestamp_ntz'2024-01-02 03:04:05' AS ordered"))
    e.sources.register("public.customers", spark.createDataFrame(CUSTOMERS, "customer_id long, region string, vip boolean"))
    e.sources.register("public.returns", spark.createDataFrame(returns, "id long, customer_id long"))
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chasm_keeps_totals(spark):
    assert rows(shop(spark).query({"metric_name": "by_region"})) == sorted([("n", 1, 40.0), ("n", None, None), (None, None, 12.0), ("s", 3, 2.0)], key=str)
    assert rows(shop(spark, "count").query({"metric_name": "by_region"})) == sorted([("n", 1, 2), ("n", None, 0), (None, None, 2), ("s", 3, 1)], key=str)
    got = rows(shop(spark, "average").query({"metric_name": "by_region"}))
    assert got == sorted([("n", 1, 20.0), ("n", None, None), (None, None, 6.0), ("s", 3, 2.0)], key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(-50, 50)), max_size=12), st.lists(st.integers(1, 5), max_size=8))
def test_chasm_equals_single_fact_truth(spark, facts, back):
    """By dimensions on the link's side a chasm's result adds up to what the fact alone gives."""
    orders = [(k, c, float(a), "a") for k, (c, a) in enumerate(facts)]
    e = shop(spark, "sum", orders, [(k, c) for k, c in enumerate(back)])
    by = {}
    for r in e.query({"metric_name": "by_region"}).collect():
        by[r.region] = by.get(r.region, 0) + (r.by_region or 0)
    assert by == {r.region: r.plain or 0 for r in e.query({"metric_name": "plain"}).collect()}


def test_chasm_filters(spark):
    e = shop(spark)
    ask = lambda *f: rows(e.query({"metric_name": "by_region", "filters": [dict(zip(("dimension", "operator", "value"), x)) for x in f]}))
    assert ask(("order_status", "eq", "a")) == sorted([("n", 1, 40.0), ("s", 3, 2.0)], key=str)
    assert ask(("return_customer_id", "lt", "2")) == [("n", 1, 40.0)]
    assert ask(("return_id", "in", "(1, 2)")) == [("n", 1, 40.0)]
    assert ask(("vip", "eq", "true")) == [("n", 1, 40.0)]


def test_chasm_guards(spark):
    for agg, request, error in (
        ("count_distinct", {"metric_name": "by_region"}, E.UnsupportedCountDistinctReaggregation),
        ("sum", {"metric_name": "by_region", "dimensions": ["region", "return_id"]}, E.FinerThanConformedGrain),
        ("sum", {"metric_name": "by_region", "dimensions": ["order_status", "return_customer_id"]}, E.FinerThanConformedGrain),
        ("sum", {"metric_name": "by_region", "time_granularity": "day"}, E.FinerThanConformedGrain),
    ):
        with pytest.raises(error):
            shop(spark, agg).query(request)
    with pytest.raises(E.LinkDimensionNotFound):
        shop(spark, text=CHASM.replace("entity_type: dimension", "entity_type: fact")).query({"metric_name": "by_region"})


def test_requests_that_fail(spark):
    e = shop(spark)
    for request, error in (
        ({"metric_name": " "}, E.EmptyMetricName),
        ({"metric_name": "nope"}, E.MetricNotFound),
        ({"metric_name": "plain", "dimensions": ["nope"]}, E.DimensionNotFound),
        ({"metric_name": "plain", "filters": [{"dimension": "nope", "operator": "eq", "value": "1"}]}, E.DimensionNotFound),
        ({"metric_name": "plain", "filters": [{"dimension": "return_id", "operator": "eq", "value": "x"}]}, E.UnsupportedRequestFeature),
        ({"metric_name": "plain", "filters": [{"dimension": "region", "operator": "in", "value": "a, b"}]}, E.UnsupportedRequestFeature),
        ({"metric_name": "plain", "filters": [{"dimension": "region", "operator": "in", "value": "('a', b') OR (1"}]}, E.UnsupportedRequestFeature),
        ({"metric_name": "plain", "time_granularity": "fortnight"}, E.DialectError),
    ):
        with pytest.raises(error) as caught:
            e.query(request)
        assert caught.value.status == (500 if error is E.DialectError else 400)
    e.load_yaml(CHASM.replace("AGG", "sum").replace("name: shop", "name: other"))
    with pytest.raises(E.AmbiguousMetric):
        e.query({"metric_name": "plain"})
    two = CHASM.replace("{name: region, type: string, sql: region}", "{name: order_status, type: string, sql: region}").replace("[region", "[order_status")
    with pytest.raises(E.AmbiguousDimension):
        shop(spark, text=two).query({"metric_name": "plain"})
    with pytest.raises(E.MeasureNotFound):
        shop(spark, text=CHASM.replace("measure: amount", "measure: none")).query({"metric_name": "plain"})
    with pytest.raises(E.UnsupportedRequestFeature):
        shop(spark, text=CHASM.replace("type: time", "type: string")).query({"metric_name": "plain", "time_granularity": "day"})
    with pytest.raises(E.SourceError):
        shop(spark, text=CHASM.replace("public.returns", "gone")).query({"metric_name": "by_region"})


def test_row_policies(spark):
    text = CHASM.replace("rls_policies: []", "rls_policies: [{claim_key: area, dimension: region}, {claim_key: vip, dimension: vip}]")
    e = shop(spark, text=text)
    assert rows(e.query({"metric_name": "plain"}, {"area": "n", "vip": "TRUE"})) == [("n", 40.0)]
    assert rows(e.query({"metric_name": "plain"}, {"area": "n"})) == rows(e.query({"metric_name": "plain"}, {"area": "n", "vip": "yes"})) == []
    assert rows(e.query({"metric_name": "plain"}, {"area": "n' OR '1'='1", "vip": "true"})) == []
    assert len(rows(e.query({"metric_name": "plain"}))) == 3
    assert rows(e.query({"metric_name": "plain", "dimensions": ["order_status"]}, {})) == [("a", 42.0), ("b", 12.0)]  # customers aren't on the path
    with pytest.raises(E.UnknownRlsDimension):
        shop(spark, text=text.replace("dimension: vip", "dimension: none")).query({"metric_name": "plain"}, {})


def test_policies_hold_for_every_entity_on_the_table(spark):
    extra = "  - {name: audit, table: public.orders, primary_key: id, dimensions: [{name: audit_status, type: string, sql: status}], measures: [], rls_policies: [{claim_key: s, dimension: audit_status}]}\njoins:"
    e = shop(spark, text=CHASM.replace("joins:", extra, 1))
    assert rows(e.query({"metric_name": "plain"}, {"s": "a"})) == [("n", 40.0), ("s", 2.0)]
    assert rows(e.query({"metric_name": "by_region"}, {"s": "a"})) == [("n", 1, 40.0), ("s", 3, 2.0)]


def test_sql_text(spark):
    e = shop(spark)
    assert e.compile_sql({"metric_name": "by_region"}, "postgres") == (
        'WITH "orders_agg" AS (SELECT "orders"."customer_id" AS "customer_id", SUM("orders"."amount") AS "amount" FROM "public"."orders" AS "orders" GROUP BY "orders"."customer_id"), '
        '"returns_agg" AS (SELECT "returns"."customer_id" AS "customer_id" FROM "public"."returns" AS "returns" GROUP BY "returns"."customer_id") '
        'SELECT "customers"."region" AS "region", "returns_agg"."customer_id" AS "return_customer_id", SUM("orders_agg"."amount") AS "by_region" FROM "orders_agg" '
        'LEFT JOIN "public"."customers" AS "customers" ON "orders_agg"."customer_id" = "customers"."customer_id" '
        'LEFT JOIN "returns_agg" ON "customers"."customer_id" = "returns_agg"."customer_id" GROUP BY "customers"."region", "returns_agg"."customer_id"'
    )
    grain = {"metric_name": "plain", "dimensions": ["order_status"], "time_granularity": "Month", "limit": 3, "filters": [{"dimension": "order_status", "operator": "eq", "value": "it's"}]}
    assert e.compile_sql(grain, "snowflake") == (
        'SELECT DATE_TRUNC(\'MONTH\', "ORDERS"."ORDERED") AS "MONTH", "ORDERS"."STATUS" AS "ORDER_STATUS", SUM("ORDERS"."AMOUNT") AS "PLAIN" FROM "PUBLIC"."ORDERS" AS "ORDERS" '
        'WHERE "ORDERS"."STATUS" = \'it\'\'s\' GROUP BY DATE_TRUNC(\'MONTH\', "ORDERS"."ORDERED"), "ORDERS"."STATUS" LIMIT 3'
    )
    assert "DATE_TRUNC(`orders`.`ordered`, MONTH) AS `month`" in e.compile_sql(grain, "bigquery")
    assert "1 = 0" in shop(spark, text=CHASM.replace("rls_policies: []", "rls_policies: [{claim_key: a, dimension: vip}]")).compile_sql({"metric_name": "plain"}, "postgres", {})
    assert " * 1.0 / NULLIF(SUM(" in shop(spark, "average").compile_sql({"metric_name": "by_region"}, "postgres")


def test_dialects():
    from metricloom.plans.dialects import BigQuery, Dialect, Postgres, Snowflake, dialect_for

    a, p, s, b = Dialect(), Postgres(), Snowflake(), BigQuery()
    assert (a.qualified('x."y'), s.qualified("a.b"), b.identifier("a`b")) == ('"x"."""y"', '"A"."B"', "`a\\`b`")
    assert (a.cast("x", "int"), p.cast("x", "int")) == ("CAST(x AS int)", "x::int")
    assert (s.json_path("c", "a'b"), b.json_path("c", "a.b"), b.unnest("x")) == ("GET_PATH(c, 'a''b')", "JSON_EXTRACT_SCALAR(c, '$.a.b')", "UNNEST(x)")
    assert a.aggregate("count_distinct", "x") == "COUNT(DISTINCT x)" and a.aggregate("average", "x") == "AVG(x)" and a.count_star == "COUNT(*)"
    assert a.order([("t.a", True), ("b", False)], 5, 2) == 'ORDER BY "t"."a" DESC, "b" ASC LIMIT 5 OFFSET 2' and a.order([]) == ""
    for d, call in itertools.product((a, p), ("json_path", "unnest")):
        with pytest.raises(E.DialectError):
            getattr(d, call)(*("c", "p")[: 2 if call == "json_path" else 1])
    with pytest.raises(E.DialectError):
        a.date_trunc("bogus", "x")
    assert dialect_for("other").name == "postgres" and dialect_for("SNOWFLAKE").name == "snowflake"
    with pytest.raises(E.DialectError):
        dialect_for("other", strict=True)


def test_service_surface(spark):
    e = shop(spark)
    assert [e.execute(t) for t in ("", "SET x = 1", "show tables", "BEGIN", "commit;")] == [None] * 5
    assert e.execute("select version()").columns == ["version"] and e.execute("SELECT 1;").collect()[0][0] == 1
    assert e.execute("SELECT count(*) AS n FROM orders;").collect()[0].n == 6
    assert rows(e.execute('SEMANTIC {"metric_name": "plain", "dimensions": ["order_status"]}')) == [("a", 42.0), ("b", 12.0)]
    with pytest.raises(E.BadRequestJson) as bad:
        e.execute("SEMANTIC {")
    assert bad.value.sqlstate == "22000" and E.MetricNotFound("x").sqlstate == "42000"
    out = e.rest({"metrics": ["plain"], "dimensions": ["order_status"], "limit": 1}, "postgres")
    assert out["columns"] == ["order_status", "plain"] and out["row_count"] == 1 and out["sql"].endswith("LIMIT 1")


def test_handshake_is_matched_as_a_whole(spark):
    e = shop(spark)
    assert e.execute("SELECT 'version()' AS v").collect()[0].v == "version()"
    assert e.execute("select  VERSION( ) ;").columns == ["version"]
    assert e.execute("SELECT count(*) AS n FROM orders -- version()").collect()[0].n == 6


def test_plain_sql_under_row_policies(spark):
    text = CHASM.replace("rls_policies: []", "rls_policies: [{claim_key: area, dimension: region}]").replace("public.customers", "customers")
    e = shop(spark, text=text)
    e.sources.register("customers", spark.createDataFrame(CUSTOMERS, "customer_id long, region string, vip boolean"))
    e.sources.register("secrets", spark.createDataFrame([(1,)], "a int"))
    claims = {"area": "n"}
    for query, want in (
        ("SELECT customer_id FROM customers", [(1,), (2,)]),
        ("SELECT c.customer_id FROM Customers c WHERE c.region = 's' OR 1 = 1;", [(1,), (2,)]),
        ("WITH x AS (SELECT * FROM customers) SELECT customer_id FROM x", [(1,), (2,)]),
        ("SELECT (SELECT count(*) FROM customers) AS n", [(2,)]),
        ("SELECT id FROM orders WHERE customer_id IN (SELECT customer_id FROM customers) -- no end", [(1,), (2,), (3,)]),
        ("SELECT id FROM orders o WHERE EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = o.customer_id)", [(1,), (2,), (3,)]),
        ("WITH customers AS (SELECT 7 AS customer_id) SELECT * FROM customers", [(7,)]),
        ("SELECT customer_id FROM customers UNION ALL (SELECT customer_id FROM customers) ORDER BY 1", [(1,), (1,), (2,), (2,)]),
        ("SELECT a FROM secrets", [(1,)]),
        ("SELECT id FROM range(2)", [(0,), (1,)]),
        ("SELECT x FROM VALUES (1), (2) AS t(x) WHERE x > (SELECT min(customer_id) FROM customers)", [(2,)]),
        ("SELECT c.customer_id, t.x FROM customers c LATERAL VIEW explode(array(5)) t AS x", [(1, 5), (2, 5)]),
        ("SELECT customer_id, row_number() OVER w AS k FROM customers WINDOW w AS (ORDER BY customer_id)", [(1, 1), (2, 2)]),
    ):
        assert rows(e.execute(query, claims)) == want, query
    assert rows(e.execute("SELECT customer_id FROM customers", {})) == []
    assert len(rows(e.execute("SELECT customer_id FROM customers"))) == 4
    spark.range(3).createOrReplaceTempView("elsewhere")
    for query in (
        "SELECT * FROM elsewhere", "SELECT * FROM default.customers", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM gone", "SELECT * FROM IDENTIFIER('customers')",
        "WITH elsewhere AS (SELECT 1) SELECT * FROM elsewhere", "SELECT * FROM customers VERSION AS OF 1", "SELECT * FROM elsewhere TIMESTAMP AS OF '2024-01-01'",
    ):
        with pytest.raises(E.UnprotectedTable) as refused:
            e.execute(query, claims)
        assert refused.value.status == 400
    for query in ("DROP VIEW customers", "CREATE TABLE t AS SELECT * FROM customers", "SELECT 1) UNION ALL (SELECT * FROM customers"):
        with pytest.raises((E.UnprotectedTable, PySparkException)):
            e.execute(query, claims)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("__allowed")]


def test_rest_says_what_it_left_out(spark):
    from metricloom.sources import envelope

    out = envelope("m", "", spark.range(5), 3)
    assert (out["row_count"], out["truncated"], len(out["rows"])) == (3, True, 3)
    assert envelope("m", "", spark.range(3), 3)["truncated"] is False


def test_policies_of_the_second_role_of_a_table(spark):
    text = """
name: staff
entities:
  - {name: workers, table: staff, primary_key: id, entity_type: fact, dimensions: [{name: worker, type: string, sql: name}], measures: [{name: heads, agg: count, sql: id}], rls_policies: [{claim_key: site, dimension: worker_site}]}
  - {name: bosses, table: staff, primary_key: id, entity_type: dimension, dimensions: [{name: boss, type: string, sql: name}], measures: []}
joins: [{left_entity: workers, left_column: boss_id, right_entity: bosses, right_column: id}]
metrics: [{name: reports, measure: heads, dimensions: [boss]}]
""".replace("{name: worker, type: string, sql: name}", "{name: worker, type: string, sql: name}, {name: worker_site, type: string, sql: site}")
    e = Engine(spark)
    e.load_yaml(text)
    e.sources.register("staff", spark.createDataFrame([(1, "ann", None, "x"), (2, "bob", 1, "x"), (3, "cyd", 4, "x"), (4, "dan", None, "y"), (5, "eve", 1, "y")], "id long, name string, boss_id long, site string"))
    assert rows(e.query({"metric_name": "reports"})) == sorted([("ann", 2), ("dan", 1), (None, 2)], key=str)
    assert rows(e.query({"metric_name": "reports"}, {"site": "x"})) == [("ann", 1)]  # dan is a boss of the other site


def test_paths_beyond_a_fact_that_is_aggregated_first(spark):
    more = "  - {name: shops, table: shops, primary_key: shop_id, entity_type: dimension, dimensions: [{name: shop_name, type: string, sql: name}], measures: []}\njoins:\n  - {left_entity: orders, left_column: shop_id, right_entity: shops, right_column: shop_id}"
    e = shop(spark, text=CHASM.replace("joins:", more, 1))
    with pytest.raises(E.FinerThanConformedGrain) as caught:
        e.query({"metric_name": "by_region", "dimensions": ["shop_name", "return_customer_id"]})
    assert (caught.value.dimension, caught.value.entity, caught.value.grain) == ("shop_name", "orders", "customer_id")


def test_broken_path(spark):
    from metricloom.plans import resolve as R

    state = shop(spark).state.snapshot()
    object.__setattr__(state, "entity", lambda name, first=None: None)
    with pytest.raises(E.BrokenPath):
        R.resolve(R.Request.of({"metric_name": "plain"}), state)


@pytest.mark.parametrize("name", sorted(catalogue.REQUESTS))
def test_compiled_sql_of_other_dialects(spark, sf, name):
    """DuckDB reads what Postgres and Snowflake are given; Spark runs its own."""
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    request, context, _ = catalogue.REQUESTS[name]
    e, metric = catalogue.engine(spark, sf), request["metric_name"]
    exact = lambda rows: sorted(([round(v, 2) if isinstance(v, float) else int(v) if isinstance(v, Decimal) else str(v) for v in r] for r in rows), key=str)
    want = exact(e.query(request, context).collect())
    for dialect in ("postgres", "snowflake"):
        assert exact(con.execute(e.compile_sql(request, dialect, context)).fetchall()) == want, dialect
    e.sources.create_views()
    assert exact(spark.sql(e.compile_sql(request, "spark", context)).collect()) == want and metric


def test_warehouse_settings(spark):
    from metricloom.sources import BigQuery, Postgres, Snowflake, SourceRegistry
    from metricloom.sources.warehouses import failure

    p = Postgres("h", "d", "u", "word", partition=("id", 0, 100, 4))
    assert p.options("t")["url"] == "jdbc:postgresql://h:5432/d" and p.options("t")["queryTimeout"] == "30" and p.options("t")["numPartitions"] == "4" and "word" not in repr(p)
    assert Snowflake("a", "u", "d", "w").options("t")["statement_timeout_in_seconds"] == "60" and "sfRole" not in Snowflake("a", "u", "d", "w").options("t")
    assert BigQuery("p", "d").options("t")["table"] == "p.d.t"
    s = SourceRegistry(spark).postgres("a", p).snowflake("b", Snowflake("a", "u", "d", "w", password="word")).bigquery("c", BigQuery("p", "d"))
    for t in s.names():
        with pytest.raises(E.ConnectionFailed) as caught:
            s.table(t)
        assert caught.value.table == t and caught.value.status == 500 and "word" not in str(caught.value)
    assert isinstance(failure("t", RuntimeError("java.sql.SQLTimeoutException: x")), E.QueryTimedOut)
    assert isinstance(failure("t", RuntimeError("UNRECOGNIZED_SQL_TYPE")), E.UnsupportedType)


def test_database_over_jdbc(spark, tmp_path):
    """Spark brings the Derby driver: a real database, with pushdown and failures."""
    from metricloom.sources import SourceRegistry

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(k, f"n{k % 3}", k * 1.5) for k in range(30)], "id int, name string, amount double").write.jdbc(url, "sales", mode="overwrite")
    s = SourceRegistry(spark).jdbc("sales", url, queryTimeout="30")
    e = Engine(spark, s)
    e.load_yaml("""
name: shop
entities:
  - {name: sales, table: sales, primary_key: id, dimensions: [{name: who, type: string, sql: name}, {name: number, type: number, sql: id}], measures: [{name: total, agg: sum, sql: amount}]}
metrics: [{name: by_who, measure: total, dimensions: [who]}]
""")
    df = e.query({"metric_name": "by_who", "filters": [{"dimension": "number", "operator": "lt", "value": "6"}]})
    assert rows(df) == [("n0", 4.5), ("n1", 7.5), ("n2", 10.5)]
    assert "LessThan(id,6)" in df._jdf.queryExecution().toString().replace("ID", "id")
    with pytest.raises(E.ConnectorError):
        SourceRegistry(spark).jdbc("gone", url).table("gone")


def test_sources(spark, sf, tmp_path):
    from metricloom.sources import SourceRegistry

    s = SourceRegistry(spark).connector("areas", "parquet", path=f"{sf}/region.parquet").parquet_dir(sf, "nation").jdbc("far", "jdbc:postgresql://nowhere/db")
    assert s.names() == ["areas", "nation", "far"] and s.table("public.areas").count() == s.table("areas").count() == 5
    s.table("nation").createOrReplaceTempView("in_catalog")
    assert s.table("in_catalog").count() == 25
    with pytest.raises(E.SourceError) as none:
        s.table("gone")
    assert none.value.sqlstate == "XX000" and none.value.status == 500


def test_paging_puts_nulls_as_postgres_does(spark):
    from metricloom.operators import Query

    df = spark.createDataFrame([(1,), (None,), (3,), (2,)], "a int")
    page = lambda *keys, **k: [r.a for r in Query.of(df).with_pagination(keys, **k).frame().collect()]
    assert page("a") == [1, 2, 3, None] and page(("a", "desc")) == [None, 3, 2, 1] and page("a", limit=2, offset=1) == [2, 3] and page("a", limit=0) == []


def test_text_rows(spark):
    df = spark.createDataFrame([(1, None, True, bytearray(b"x"), 1.5), (None, "a", None, None, None)], "a int, b string, c boolean, d binary, e double")
    assert [tuple(r) for r in to_text_rows(df).collect()] == [("1", "NULL", "true", "<bytes>", "1.5"), ("NULL", "a", "NULL", "NULL", "NULL")]


def test_pushdown_reaches_the_scan(spark, sf):
    plan = catalogue.engine(spark, sf).query({"metric_name": "quantity_by_return_flag", "filters": [{"dimension": "line_number", "operator": "gt", "value": "3"}]})._jdf.queryExecution().toString()
    assert "GreaterThan(l_linenumber,3)" in plan and "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_returnflag:string>" in plan


def test_command_line_run(spark, sf, capsys):
    from metricloom.__main__ import main

    request = 'SEMANTIC {"metric_name": "total_lines", "filters": [{"dimension": "return_flag", "operator": "eq", "value": "R"}]}'
    assert main(["run", request, "--models", str(catalogue.MODELS), "--tables", sf]) == 0 and "total_lines" in capsys.readouterr().out
    assert main(["run", "SELECT count(*) AS n FROM region", "--tables", sf]) == 0 and "|5" in capsys.readouterr().out
    assert main(["run", "BEGIN"]) == 0 and capsys.readouterr().out.strip() == "OK"
    assert main(["run", "SEMANTIC {"]) == 1 and "BadRequestJson" in capsys.readouterr().err


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = catalogue.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    order = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=order) == sorted(cur.fetchall(), key=order)
