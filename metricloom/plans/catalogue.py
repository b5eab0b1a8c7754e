"""The registered queries: requests against two example models, and hand-written plans, each with its SQL.

Sums over money columns are of doubles; they are rounded on both sides, since the order of additions is free.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.engine import Engine
from metricloom.functions import cast_as, combine_eq, date_trunc, function_call, json_path, literal_num, literal_str, null_if, or_any, unnest
from metricloom.operators import Query, count_star, raw, time_spine
from metricloom.sources import SourceRegistry, to_text_rows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
MODELS = Path(__file__).with_name("models")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the example models over a folder of Parquet tables."""
    e = Engine(spark, SourceRegistry(spark).parquet_dir(sf_dir, *TABLES))
    e.load_dir(MODELS)
    return e


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by segment through a chasm: two facts on one dimension, without fan-out."""
    return engine(spark, sf_dir).query({"metric_name": "revenue_chasm"})


def _filter(dimension: str, operator: str, value: str) -> dict:
    return {"dimension": dimension, "operator": operator, "value": value}


#: name: (request, user context, SQL); {m} in the SQL is the metric's column.
REQUESTS: dict[str, tuple[dict, dict | None, str]] = {
    "sum_by_status": ({"metric_name": "quantity_by_return_flag"}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem GROUP BY 1"),
    "count_by_status": ({"metric_name": "line_count_by_flag"}, None, "SELECT l_returnflag AS return_flag, count(l_orderkey) AS {m} FROM lineitem GROUP BY 1"),
    "avg_by_status": ({"metric_name": "avg_quantity_by_flag"}, None, "SELECT l_returnflag AS return_flag, avg(l_quantity) AS {m} FROM lineitem GROUP BY 1"),
    "min_by_status": ({"metric_name": "min_price_by_flag"}, None, "SELECT l_returnflag AS return_flag, min(l_extendedprice) AS {m} FROM lineitem GROUP BY 1"),
    "max_by_status": ({"metric_name": "max_price_by_flag"}, None, "SELECT l_returnflag AS return_flag, max(l_extendedprice) AS {m} FROM lineitem GROUP BY 1"),
    "count_distinct_by_status": ({"metric_name": "distinct_parts_by_flag"}, None, "SELECT l_returnflag AS return_flag, count(DISTINCT l_partkey) AS {m} FROM lineitem GROUP BY 1"),
    "global_sum": ({"metric_name": "total_quantity"}, None, "SELECT sum(l_quantity) AS {m} FROM lineitem"),
    "global_count": ({"metric_name": "total_lines"}, None, "SELECT count(l_orderkey) AS {m} FROM lineitem"),
    "custom_dimension": ({"metric_name": "quantity_by_return_flag", "dimensions": ["line_status"]}, None, "SELECT l_linestatus AS line_status, sum(l_quantity) AS {m} FROM lineitem GROUP BY 1"),
    "multi_dimension": ({"metric_name": "total_quantity", "dimensions": ["return_flag", "line_status", "return_flag"]}, None, "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, sum(l_quantity) AS {m} FROM lineitem GROUP BY 1, 2"),
    "limit_above_rows": ({"metric_name": "quantity_by_return_flag", "limit": 1000}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem GROUP BY 1 LIMIT 1000"),
    "measure_expression": ({"metric_name": "discounted_by_flag"}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity * 2 + l_linenumber) AS {m} FROM lineitem GROUP BY 1"),
    "filter_eq": ({"metric_name": "total_lines", "filters": [_filter("return_flag", "eq", "R")]}, None, "SELECT count(l_orderkey) AS {m} FROM lineitem WHERE l_returnflag = 'R'"),
    "filter_not_eq": ({"metric_name": "total_lines", "filters": [_filter("return_flag", "not_eq", "'R'")]}, None, "SELECT count(l_orderkey) AS {m} FROM lineitem WHERE l_returnflag <> 'R'"),
    "filter_gt": ({"metric_name": "quantity_by_return_flag", "filters": [_filter("line_number", "gt", "3")]}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem WHERE l_linenumber > 3 GROUP BY 1"),
    "filter_lt": ({"metric_name": "quantity_by_return_flag", "filters": [_filter("line_number", "lt", "3")]}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem WHERE l_linenumber < 3 GROUP BY 1"),
    "filter_gte": ({"metric_name": "quantity_by_return_flag", "filters": [_filter("ship_date", "gte", "1995-06-01")]}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1"),
    "filter_lte": ({"metric_name": "quantity_by_return_flag", "filters": [_filter("line_number", "lte", "2")]}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1"),
    "filter_in": ({"metric_name": "quantity_by_return_flag", "filters": [_filter("line_number", "in", "(1, 3, 5)")]}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem WHERE l_linenumber IN (1, 3, 5) GROUP BY 1"),
    "filter_in_strings": ({"metric_name": "total_lines", "filters": [_filter("return_flag", "in", "('A','N')")]}, None, "SELECT count(l_orderkey) AS {m} FROM lineitem WHERE l_returnflag IN ('A', 'N')"),
    "filter_and": ({"metric_name": "total_quantity", "dimensions": ["line_status"], "filters": [_filter("return_flag", "eq", "N"), _filter("line_number", "gte", "2")]}, None, "SELECT l_linestatus AS line_status, sum(l_quantity) AS {m} FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber >= 2 GROUP BY 1"),
    "filter_escaped_quote": ({"metric_name": "total_lines", "filters": [_filter("return_flag", "not_eq", "O'Brien' OR '1'='1")]}, None, "SELECT count(l_orderkey) AS {m} FROM lineitem WHERE l_returnflag <> 'O''Brien'' OR ''1''=''1'"),
    "filter_joined": ({"metric_name": "quantity_by_return_flag", "filters": [_filter("segment", "eq", "BUILDING")]}, None, "SELECT l_returnflag AS return_flag, sum(l_quantity) AS {m} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1"),
    "join_one_hop_left": ({"metric_name": "total_quantity", "dimensions": ["order_priority"]}, None, "SELECT o_orderpriority AS order_priority, sum(l_quantity) AS {m} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "join_multi_hop": ({"metric_name": "total_quantity", "dimensions": ["customer_nation"]}, None, "SELECT n_name AS customer_nation, sum(l_quantity) AS {m} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "join_star": ({"metric_name": "total_quantity", "dimensions": ["order_priority", "brand"]}, None, "SELECT o_orderpriority AS order_priority, p_brand AS brand, sum(l_quantity) AS {m} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "join_inner": ({"metric_name": "total_quantity", "dimensions": ["brand"]}, None, "SELECT p_brand AS brand, sum(l_quantity) AS {m} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "join_full": ({"metric_name": "nations_by_supplier"}, None, "SELECT s_name AS maker_name, count(n_nationkey) AS {m} FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1"),
    "join_reverse_edge": ({"metric_name": "shoppers_by_status"}, None, "SELECT o_orderstatus AS order_status, count(c_custkey) AS {m} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "join_role_playing": ({"metric_name": "quantity_by_trade_lane"}, None, "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, sum(l_quantity) AS {m} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2"),
    "join_two_entities": ({"metric_name": "zones_count"}, None, "SELECT n_regionkey AS zone_key, count(n_nationkey) AS {m} FROM nation GROUP BY 1"),
    "join_cross_model": ({"metric_name": "buyers_by_territory"}, None, "SELECT lower(r_name) AS territory, count(c_custkey) AS {m} FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_expressions": ({"metric_name": "balance_by_territory", "filters": [_filter("territory", "in", "('asia', 'europe')")]}, None, "SELECT lower(r_name) AS territory, c_mktsegment AS buyer_segment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS {m} FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) IN ('asia', 'europe') GROUP BY 1, 2"),
    **{
        f"grain_{g}": ({"metric_name": "events_total", "time_granularity": g.upper() if g == "day" else g}, None, f"SELECT CAST(date_trunc('{g}', ts) AS TIMESTAMP) AS {g}, count(event_id) AS {{m}} FROM events GROUP BY 1")
        for g in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
    },
    "grain_plus_dim": ({"metric_name": "events_by_type", "time_granularity": "month"}, None, "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, event_type, count(event_id) AS {m} FROM events GROUP BY 1, 2"),
    "chasm_sum": ({"metric_name": "revenue_chasm"}, None, "CHASM sum(o_totalprice) sum(p)"),
    "chasm_count": ({"metric_name": "orders_placed_chasm"}, None, "CHASM count(o_orderkey) CAST(sum(p) AS BIGINT)"),
    "chasm_min": ({"metric_name": "min_order_chasm"}, None, "CHASM min(o_totalprice) min(p)"),
    "chasm_max": ({"metric_name": "max_order_chasm"}, None, "CHASM max(o_totalprice) max(p)"),
    "chasm_avg": ({"metric_name": "avg_order_chasm"}, None, "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS s, count(o_totalprice) AS c FROM orders GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events) SELECT c_mktsegment AS shopper_segment, user_id AS event_user_id, sum(s) / nullif(sum(c), 0) AS {m} FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON c_custkey = user_id GROUP BY 1, 2"),
    "chasm_with_fact_key_dim": ({"metric_name": "revenue_chasm", "dimensions": ["order_customer_id", "event_user_id"]}, None, "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS p FROM orders GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events) SELECT o_custkey AS order_customer_id, user_id AS event_user_id, sum(p) AS {m} FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON c_custkey = user_id GROUP BY 1, 2"),
    "chasm_with_filter": ({"metric_name": "revenue_chasm", "filters": [_filter("order_status", "eq", "F"), _filter("event_type", "eq", "purchase"), _filter("shopper_segment", "not_eq", "MACHINERY")]}, None, "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT c_mktsegment AS shopper_segment, user_id AS event_user_id, sum(p) AS {m} FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON c_custkey = user_id WHERE user_id IS NOT NULL AND c_mktsegment <> 'MACHINERY' GROUP BY 1, 2"),
    "rls_fact": ({"metric_name": "guarded_orders"}, {"status": "F", "floor": "3"}, "SELECT o_orderstatus AS guarded_status, count(o_orderkey) AS {m} FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "rls_joined_dimension": ({"metric_name": "revenue_by_status", "dimensions": ["order_status", "shopper_segment"]}, {"segment": "BUILDING", "status": "O"}, "SELECT o_orderstatus AS order_status, c_mktsegment AS shopper_segment, sum(o_totalprice) AS {m} FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' GROUP BY 1, 2"),
    "rls_number": ({"metric_name": "guarded_parts"}, {"size": "7"}, "SELECT p_size AS part_size, count(p_partkey) AS {m} FROM part WHERE p_size = 7 GROUP BY 1"),
    "rls_bad_number_deny": ({"metric_name": "guarded_parts"}, {"size": "seven"}, "SELECT p_size AS part_size, count(p_partkey) AS {m} FROM part WHERE 1 = 0 GROUP BY 1"),
    "rls_missing_claim": ({"metric_name": "guarded_orders", "dimensions": ["guarded_status"]}, {}, "SELECT o_orderstatus AS guarded_status, count(o_orderkey) AS {m} FROM orders WHERE 1 = 0 GROUP BY 1"),
    "rls_deny_global": ({"metric_name": "guarded_order_total"}, {}, "SELECT count(o_orderkey) AS {m} FROM orders WHERE 1 = 0"),
    "rls_no_context": ({"metric_name": "guarded_orders"}, None, "SELECT o_orderstatus AS guarded_status, count(o_orderkey) AS {m} FROM orders GROUP BY 1"),
    "rls_role_playing": ({"metric_name": "quantity_by_trade_lane"}, {"nation": "NATION_3", "segment": "BUILDING", "status": "F"}, "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, sum(l_quantity) AS {m} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_name = 'NATION_3' AND sn.n_name = 'NATION_3' AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' GROUP BY 1, 2"),
    "rls_chasm": ({"metric_name": "revenue_chasm"}, {"segment": "BUILDING", "status": "F"}, "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events) SELECT c_mktsegment AS shopper_segment, user_id AS event_user_id, sum(p) AS {m} FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2"),
}

#: Metrics over doubles and the digits that they are compared to.
_DIGITS = {"revenue_chasm": 2, "avg_order_chasm": 6, "revenue_by_status": 2, "avg_quantity_by_flag": 6}


def _sql(request: dict, text: str) -> str:
    metric = request["metric_name"]
    if text.startswith("CHASM"):
        inner, outer = text[6:].split(" ", 1)
        text = f"WITH o AS (SELECT o_custkey, {inner} AS p FROM orders GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events) SELECT c_mktsegment AS shopper_segment, user_id AS event_user_id, {outer} AS {{m}} FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON c_custkey = user_id GROUP BY 1, 2"
    text = text.replace("{m}", metric)
    return f"SELECT * REPLACE (round({metric}, {_DIGITS[metric]}) AS {metric}) FROM ({text})" if metric in _DIGITS else text


def _request(request: dict, context: dict | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, metric = engine(spark, sf_dir).query(request, context), request["metric_name"]
        return df.withColumn(metric, F.round(metric, _DIGITS[metric])) if metric in _DIGITS else df

    return run


def _having(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table
    return Query.of(t("lineitem")).group_by(F.col("l_suppkey")).agg(count_star().alias("n_lines"), F.sum("l_quantity").alias("quantity")).having(F.col("n_lines") > 600, F.col("quantity") > 100).frame()


def _order_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table
    return Query.of(t("orders")).select(F.col("o_orderkey"), F.col("o_totalprice")).with_pagination((("o_totalprice", "desc"), "o_orderkey"), limit=20, offset=5).frame()


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table
    return Query.of(t("customer")).select(F.col("c_custkey"), F.col("c_acctbal")).order_by(("c_acctbal", "desc"), "c_custkey").limit(10).frame()


def _count_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query.of(engine(spark, sf_dir).sources.table("events")).group_by(F.col("event_type")).agg(count_star().alias("n")).frame()


def _cast_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("orders")
    return Query.of(t).group_by(F.col("o_orderstatus")).agg(cast_as(F.sum(cast_as(F.col("o_totalprice"), "decimal(18,2)")), "float8").alias("total")).frame()


def _cast_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("orders")
    return Query.of(t).group_by(cast_as(F.col("o_orderdate"), "date").alias("order_day")).agg(count_star().alias("n")).frame()


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("events")
    return Query.of(t).group_by(json_path(F.col("props"), "k").alias("k")).agg(count_star().alias("n")).frame()


def _unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("embeddings")
    flat = Query.of(t).select(F.col("label"), unnest(F.col("embedding")).alias("x"))
    return Query.of(flat).group_by(F.col("label")).agg(count_star().alias("n"), F.max("x").alias("largest")).frame()


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("events")
    days = Query.of(t).group_by(date_trunc("day", F.col("ts")).alias("day")).agg(count_star().alias("n"))
    spine = time_spine(spark, "day", "2023-12-25", "2024-02-10")
    return Query.of(spine).join(days, combine_eq(F.col("time_spine"), F.col("day"))).select(F.col("time_spine"), F.coalesce("n", F.lit(0)).alias("n")).frame()


def _cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table
    totals = Query.of(t("orders")).group_by(F.col("o_custkey")).agg(F.max("o_totalprice").alias("largest"))
    return Query.of(t("customer"), "c").join(Query.of(totals, "totals"), F.col("c.c_custkey") == F.col("totals.o_custkey"), "inner").group_by(F.col("c_mktsegment")).agg(F.max("largest").alias("largest"), count_star().alias("buyers")).frame()


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("lineitem")
    return Query.of(t).group_by(raw("l_linenumber % 2").alias("odd")).agg(raw("count(CASE WHEN l_returnflag = 'R' THEN 1 END)").alias("returned")).frame()


def _function(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("customer")
    return Query.of(t).group_by(function_call("lower", F.col("c_mktsegment")).alias("segment")).agg(function_call("max", function_call("abs", F.col("c_acctbal"))).alias("largest")).frame()


def _combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("lineitem")
    either = or_any(combine_eq(F.col("l_returnflag"), literal_str("R")), combine_eq(F.col("l_linenumber"), literal_num(" 4 ")))
    return Query.of(t).where(either, F.col("l_quantity") > literal_num("10.5")).agg(count_star().alias("n")).frame()


def _null_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).sources.table("lineitem")
    return Query.of(t).group_by(null_if(F.col("l_returnflag"), F.lit("N")).alias("flag")).agg(count_star().alias("n")).frame()


def _passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).execute("SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name;")


def _semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).execute('SEMANTIC {"metric_name": "events_by_type", "filters": [{"dimension": "event_user_id", "operator": "lt", "value": "50"}]}')


def _compiled_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL text that a chasm request compiles to, run as such."""
    e = engine(spark, sf_dir)
    e.sources.create_views()
    return spark.sql(e.compile_sql({"metric_name": "orders_placed_chasm", "filters": [_filter("shopper_segment", "eq", "BUILDING")]}, "spark"))


def _compiled_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL text of joined entities whose dimension and measure are expressions, run as such."""
    e = engine(spark, sf_dir)
    e.sources.create_views()
    return spark.sql(e.compile_sql({"metric_name": "balance_by_territory"}, "spark"))


def _guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL under row policies: every source, also in subqueries, shows the allowed rows alone."""
    text = "WITH big AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000) SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1, 2"
    return engine(spark, sf_dir).execute(text, {"status": "F", "segment": "BUILDING"})


def _text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_text_rows(engine(spark, sf_dir).query({"metric_name": "line_count_by_flag"}))


#: name: (plan, SQL)
PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "having": (_having, "SELECT l_suppkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 HAVING count(*) > 600 AND sum(l_quantity) > 100"),
    "order_limit_offset": (_order_limit_offset, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "top_k": (_top_k, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "count_star": (_count_star, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "cast_decimal": (_cast_decimal, "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"),
    "cast_date": (_cast_date, "SELECT CAST(o_orderdate AS DATE) AS order_day, count(*) AS n FROM orders GROUP BY 1"),
    "json_access": (_json, "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "unnest": (_unnest, "SELECT label, count(*) AS n, max(x) AS largest FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY 1"),
    "time_spine": (_spine, "SELECT time_spine, coalesce(n, 0) AS n FROM (SELECT CAST(range AS TIMESTAMP) AS time_spine FROM range(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-11', INTERVAL 1 DAY)) LEFT JOIN (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1) ON time_spine = day"),
    "cte": (_cte, "WITH totals AS (SELECT o_custkey, max(o_totalprice) AS largest FROM orders GROUP BY 1) SELECT c_mktsegment, max(largest) AS largest, count(*) AS buyers FROM customer JOIN totals ON c_custkey = o_custkey GROUP BY 1"),
    "raw_expr": (_raw, "SELECT l_linenumber % 2 AS odd, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM lineitem GROUP BY 1"),
    "function_call": (_function, "SELECT lower(c_mktsegment) AS segment, max(abs(c_acctbal)) AS largest FROM customer GROUP BY 1"),
    "combinators": (_combinators, "SELECT count(*) AS n FROM lineitem WHERE (l_returnflag = 'R' OR l_linenumber = 4) AND l_quantity > 10.5"),
    "null_if": (_null_if, "SELECT nullif(l_returnflag, 'N') AS flag, count(*) AS n FROM lineitem GROUP BY 1"),
    "passthrough_sql": (_passthrough, "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "semantic_text": (_semantic_text, "SELECT event_type, count(event_id) AS events_by_type FROM events WHERE user_id < 50 GROUP BY 1"),
    "compiled_sql": (_compiled_sql, "WITH o AS (SELECT o_custkey, count(o_orderkey) AS p FROM orders GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events) SELECT c_mktsegment AS shopper_segment, user_id AS event_user_id, CAST(sum(p) AS BIGINT) AS orders_placed_chasm FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2"),
    "compiled_expressions": (_compiled_expressions, "SELECT lower(r_name) AS territory, c_mktsegment AS buyer_segment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS balance_by_territory FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "rls_passthrough": (_guarded_sql, "SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' GROUP BY 1, 2"),
    "text_rows": (_text_rows, "SELECT l_returnflag AS col_0, CAST(count(l_orderkey) AS VARCHAR) AS col_1 FROM lineitem GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _request(r, c) for name, (r, c, _) in REQUESTS.items()} | {name: f for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(r, s) for name, (r, _, s) in REQUESTS.items()} | {name: s for name, (_, s) in PLANS.items()}
