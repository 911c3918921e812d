"""The query catalogue over the driver's tables: one query for each operator, with its SQL.

"""

from __future__ import annotations

import base64
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .operators import aggregate as A
from .operators import find as Q
from .operators.joins import JoinSpec
from .plans.table import Table, adapt, parquet_table
from .sources import formats

Query = Callable[[SparkSession, str], DataFrame]
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "benchmark": "item_id", "pages": "page_id"}
INDEXES = {"orders": ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate"], "customer": ["c_nationkey", "c_mktsegment"], "nation": ["n_regionkey", "n_name"], "events": ["user_id", "value"], "labels": ["quality"]}

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, alias: str | None = None) -> Table:
    return parquet_table(spark, f"{sf_dir}/{name}.parquet", alias or name, KEYS.get(name), INDEXES.get(name, ()))


def add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _oracle[name] = sql


def leaf(field: str, op: str, value: Any = None, value2: Any = None) -> dict:
    return {"field": field, "op": op, "value": value, "value2": value2}


# filters: all rows that match, with the key and one more column


def filtered(name: str, source: str, columns: str, criteria: Any, condition: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.where(table(spark, sf_dir, source), criteria).select(*columns.split(", "))

    add(name, query, f"SELECT {columns} FROM {source} WHERE {condition}")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_O, _C, _P, _L, _D = "o_orderkey, o_totalprice", "c_custkey, c_name", "p_partkey, p_name", "l_orderkey, l_partkey, l_suppkey, l_linenumber", "doc_id, n_chars"


def fold(column: str) -> str:
    return f"translate({column}, '{_UP}', '{_LOW}')"


for _name, _source, _columns, _criteria, _sql in [
    ("f01_eq", "orders", _O, [leaf("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'"),
    ("f02_neq", "customer", _C, [leaf("c_mktsegment", "neq", "BUILDING")], "c_mktsegment <> 'BUILDING'"),
    ("f03_lt", "orders", _O, [leaf("o_totalprice", "lt", 50000)], "o_totalprice < 50000"),
    ("f04_gt", "part", _P, [leaf("p_size", "gt", 40)], "p_size > 40"),
    ("f05_lte", "orders", _O, [leaf("o_orderdate", "lte", "19960101")], "o_orderdate <= TIMESTAMP '1996-01-01'"),
    ("f06_gte", "lineitem", _L, [leaf("l_quantity", "gte", "45")], "l_quantity >= 45"),
    ("f07_like_contains", "part", _P, [leaf("p_type", "like", "%A%")], "contains(p_type, 'A')"),
    ("f07_like_prefix", "orders", _O, [leaf("o_orderpriority", "like", "1%")], "starts_with(o_orderpriority, '1')"),
    ("f08_not_like", "orders", _O, [leaf("o_orderpriority", "not_like", "1*")], "NOT starts_with(o_orderpriority, '1')"),
    ("f09_contains", "events", "event_id, event_type", [leaf("props", "contains", "1")], "contains(props, '1')"),
    ("f10_not_contains", "part", _P, [leaf("p_name", "ncontains", "1")], "NOT contains(p_name, '1')"),
    ("f11_starts_with", "customer", _C, [leaf("c_mktsegment", "starts", "A")], "starts_with(c_mktsegment, 'A')"),
    ("f12_ends_with", "customer", _C, [leaf("c_name", "ends", "7")], "suffix(c_name, '7')"),
    ("f13_in", "orders", _O, [leaf("o_orderstatus", "in", "F,P")], "o_orderstatus IN ('F', 'P')"),
    ("f14_not_in", "customer", _C, [leaf("c_nationkey", "nin", ["1", "2", "3"])], "c_nationkey NOT IN (1, 2, 3)"),
    ("f15_between", "orders", _O, [leaf("o_totalprice", "between", 100000, 200000)], "o_totalprice BETWEEN 100000 AND 200000"),
    ("f16_exists", "documents", _D, [leaf("text", "exists")], "text IS NOT NULL AND text <> ''"),
    ("f17_not_exists", "documents", _D, [leaf("source", "not_exists")], "source IS NULL OR source = ''"),
    ("f18_len_eq", "customer", _C, [leaf("c_mktsegment", "len_eq", 9)], "strlen(c_mktsegment) = 9"),
    ("f19_len_neq", "customer", _C, [leaf("c_mktsegment", "len_neq", 9)], "strlen(c_mktsegment) <> 9"),
    ("f20_len_lt", "documents", _D, [leaf("text", "len_lt", 1000)], "strlen(text) < 1000"),
    ("f21_len_gt", "documents", _D, [leaf("text", "len_gt", 5000)], "strlen(text) > 5000"),
    ("f22_len_lte", "documents", _D, [leaf("text", "len_lte", 800)], "strlen(text) <= 800"),
    ("f23_len_gte", "conversations", "conv_id, turn", [leaf("text", "len_gte", 200)], "strlen(text) >= 200"),
    ("f24_len_between", "documents", _D, [leaf("text", "len_between", 1000, 2000)], "strlen(text) BETWEEN 1000 AND 2000"),
    ("f25_ilike", "customer", _C, [leaf("c_mktsegment", "ilike", "auto%")], f"starts_with({fold('c_mktsegment')}, 'auto')"),
    ("f26_not_ilike", "documents", _D, [leaf("text", "not_ilike", "%THE%")], f"NOT contains({fold('text')}, 'the')"),
    ("f27_icontains", "documents", _D, [leaf("text", "icontains", "ÉTRE")], f"contains({fold('text')}, 'Étre')"),
    ("f28_not_icontains", "documents", _D, [leaf("text", "incontains", "AND")], f"NOT contains({fold('text')}, 'and')"),
    ("f29_istarts_with", "documents", _D, [leaf("text", "istarts", "THE")], f"starts_with({fold('text')}, 'the')"),
    ("f30_iends_with", "customer", _C, [leaf("c_mktsegment", "iends_with", "ING")], f"suffix({fold('c_mktsegment')}, 'ing')"),
    ("f31_eq_field", "lineitem", _L, [leaf("l_discount", "eq_field", "l_tax")], "l_discount = l_tax"),
    ("f32_neq_field", "lineitem", _L, [leaf("l_discount", "neq_field", "l_tax")], "l_discount <> l_tax"),
    ("f33_lt_field", "lineitem", _L, [leaf("l_discount", "lt_field", "l_tax")], "l_discount < l_tax"),
    ("f34_gt_field", "lineitem", _L, [leaf("l_discount", "gt_field", "l_tax")], "l_discount > l_tax"),
    ("f35_lte_field", "lineitem", _L, [leaf("l_orderkey", "lte_field", "l_partkey")], "l_orderkey <= l_partkey"),
    ("f36_gte_field", "lineitem", _L, [leaf("l_orderkey", "gte_field", "l_partkey")], "l_orderkey >= l_partkey"),
    ("f37_regex", "part", _P, [leaf("p_brand", "regex", "^[[:alpha:]]+#[1-3][0-9]*$")], r"regexp_matches(p_brand, '^[a-zA-Z]+#[1-3][0-9]*$')"),
    ("f38_not_regex", "part", _P, [leaf("p_brand", "not_regex", "(1|3)$")], "NOT regexp_matches(p_brand, '(1|3)$')"),
    ("f40_and", "orders", _O, [leaf("o_orderstatus", "eq", "O"), {"and": [leaf("o_totalprice", "gt", 150000), leaf("o_orderpriority", "eq", "1-URGENT")]}], "o_orderstatus = 'O' AND o_totalprice > 150000 AND o_orderpriority = '1-URGENT'"),
    ("f41_or", "orders", _O, {"or": [leaf("o_totalprice", "lt", 10000), {"and": [leaf("o_orderstatus", "eq", "P"), {"or": [leaf("o_orderpriority", "starts", "5"), leaf("o_totalprice", "gte", 300000)]}]}]}, "o_totalprice < 10000 OR (o_orderstatus = 'P' AND (starts_with(o_orderpriority, '5') OR o_totalprice >= 300000))"),
    ("f42_simple_equality", "orders", _O, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"}, "o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'"),
    ("f43_single_leaf", "orders", _O, leaf("o_custkey", "eq", "7"), "o_custkey = 7"),
    ("f45_composite", "lineitem", _L, [leaf("l_returnflag+l_linestatus", "in", ["AF", "NO"])], "l_returnflag || l_linestatus IN ('AF', 'NO')"),
    ("f46_unknown_field", "region", "r_regionkey, r_name", [leaf("nosuch", "not_exists")], "true"),
    ("f47_typed_literals", "orders", _O, [leaf("o_orderdate", "between", "1995-01-01", "1995-06-30 12:00:00"), leaf("o_totalprice", "gt", "1e5")], "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30 12:00:00' AND o_totalprice > 1e5"),
    ("f48_text_comparison", "lineitem", _L, [leaf("l_linestatus+l_returnflag", "gte", "O")], "l_linestatus || l_returnflag >= 'O'"),
    ("f49_datetime_in", "orders", _O, [leaf("o_orderdate", "in", ["19950101", "19960229", "19970315"])], "o_orderdate IN (TIMESTAMP '1995-01-01', TIMESTAMP '1996-02-29', TIMESTAMP '1997-03-15')"),
]:
    filtered(_name, _source, _columns, _criteria, _sql)


# scans, points, pages


def on(source: str, plan: Callable[[Table], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(table(spark, sf_dir, source))


add("sc1_full_scan", on("nation", lambda t: t.data), "SELECT * FROM nation")
add("sc2_point_search", on("orders", lambda t: Q.where(t, [leaf("o_custkey", "eq", 11)])), "SELECT * FROM orders WHERE o_custkey = 11")
add("sc3_range_scan", on("orders", lambda t: Q.where(t, [leaf("o_orderkey", "gt", 100), leaf("o_orderkey", "lte", 900)]).select("o_orderkey", "o_orderdate")), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900")
add("sc4_ordered_walk", on("events", lambda t: Q.find(t, order_by="value", order="desc", limit=50, fields="value,user_id")), "SELECT event_id, value, user_id FROM events ORDER BY value DESC, event_id DESC LIMIT 50")
add("sc5_index_only_count", on("orders", lambda t: Q.count(t, [leaf("o_orderpriority", "neq", "5-LOW")])), "SELECT count(*) AS count FROM orders WHERE o_orderpriority <> '5-LOW'")
add("sc6_get", on("customer", lambda t: Q.get(t, 42)), "SELECT * FROM customer WHERE c_custkey = 42")
add("sc7_get_fields", on("customer", lambda t: Q.get(t, 42, "c_name,c_acctbal")), "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
add("sc8_multi_get", on("customer", lambda t: Q.get_many(t, [9, 3, -1, 5], "c_name")), "SELECT k AS c_custkey, c_name, c_custkey IS NOT NULL AS _found FROM (VALUES (9), (3), (-1), (5)) v(k) LEFT JOIN customer ON c_custkey = k")
add("sc9_exists", on("part", lambda t: Q.get(t, 10, []).agg((F.count(F.lit(1)) > 0).alias("found"))), "SELECT count(*) > 0 AS found FROM part WHERE p_partkey = 10")
add("sc10_multi_exists", on("part", lambda t: Q.exists_many(t, [1, 0, 7])), "SELECT k AS p_partkey, p_partkey IS NOT NULL AS found FROM (VALUES (1), (0), (7)) v(k) LEFT JOIN part ON p_partkey = k")
add("sc11_not_exists", on("part", lambda t: Q.not_exists(t, [1, 0, 7, -5])), "SELECT k::BIGINT AS p_partkey FROM (VALUES (1), (0), (7), (-5)) v(k) WHERE k NOT IN (SELECT p_partkey FROM part)")
add("sc12_keys_page", on("orders", lambda t: Q.keys(t, 20, 10)), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 10 OFFSET 20")
add("sc13_fetch_page", on("part", lambda t: Q.fetch(t, 50, 25, "p_name,p_size")), "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 25")
add("sc14_size", on("lineitem", lambda t: Q.count(t)), "SELECT count(*) AS count FROM lineitem")
add("pr1_projection", on("part", lambda t: Q.project(t, t.data, "p_size,p_brand,nosuch")), "SELECT p_partkey, p_size, p_brand, NULL::VARCHAR AS nosuch FROM part")
add("pr2_composite_projection", on("supplier", lambda t: Q.project(t, t.data, "s_name+s_nationkey").withColumnRenamed("s_name+s_nationkey", "joined")), "SELECT s_suppkey, s_name || s_nationkey::VARCHAR AS joined FROM supplier")
add("pr3_offset_limit", on("orders", lambda t: Q.find(t, [leaf("o_orderstatus", "eq", "O")], "o_totalprice", 10, 15)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 15 OFFSET 10")
add("pr4_excluded_keys", on("orders", lambda t: Q.find(t, [leaf("o_orderstatus", "eq", "O")], "o_custkey", 0, 20, list(range(0, 400)))), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT BETWEEN 0 AND 399 ORDER BY 1 LIMIT 20")
add("s1_order_asc", on("customer", lambda t: Q.find(t, fields="c_acctbal", order_by="c_acctbal", limit=30)), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 30")
add("s6_topk", on("orders", lambda t: Q.find(t, fields="o_totalprice,o_orderdate", order_by="o_totalprice", order="desc", limit=100)), "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
add("s7_multi_key", on("orders", lambda t: Q.find(t, fields="o_orderpriority,o_totalprice", order_by=["o_orderpriority", "o_totalprice"], limit=40)), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY 2, 3, 1 LIMIT 40")
add("c1_cursor_first", on("orders", lambda t: Q.cursor_page(t, "o_orderpriority", None, 25, fields="o_custkey")), "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25")
add("c2_cursor_next", on("orders", lambda t: Q.cursor_page(t, "o_orderpriority", {"o_orderpriority": "2-HIGH", "o_orderkey": 300}, 25)), "SELECT * FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 300) ORDER BY o_orderpriority, o_orderkey LIMIT 25")
add("c3_cursor_desc", on("orders", lambda t: Q.cursor_page(t, "o_totalprice", {"o_totalprice": 200000, "o_orderkey": 0}, 25, order="desc")), "SELECT * FROM orders WHERE o_totalprice < 200000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
add("c7_cursor_filtered", on("orders", lambda t: Q.cursor_page(t, "o_orderdate", {"o_orderdate": "19950101", "o_orderkey": 10}, 25, [leaf("o_orderstatus", "eq", "F")], "o_orderstatus")), "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND (o_orderdate > TIMESTAMP '1995-01-01' OR (o_orderdate = TIMESTAMP '1995-01-01' AND o_orderkey > 10)) ORDER BY o_orderdate, o_orderkey LIMIT 25")


# joins


def joined(name: str, driver: str, specs: list[tuple], sql: str, **find: Any) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        joins = [JoinSpec(table(spark, sf_dir, remote), local, KEYS[remote] if at == "key" else at, as_, kind, tuple(fields)) for remote, local, at, as_, kind, fields in specs]
        df = Q.find(table(spark, sf_dir, driver), joins=joins, **find)
        return df.toDF(*(c.replace(".", "_") for c in df.columns))

    add(name, query, sql)


_ALL = {"limit": Q.ALL}
joined("j1_inner_key", "orders", [("customer", "o_custkey", "key", "c", "inner", ["c_name", "c_mktsegment"])], "SELECT o_orderkey AS orders_key, o_totalprice AS orders_o_totalprice, c_name AS c_c_name, c_mktsegment AS c_c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", criteria=[leaf("o_totalprice", "gt", 100000)], fields="o_totalprice", **_ALL)
joined("j2_left_key", "documents", [("labels", "doc_id", "key", "l", "left", ["quality", "toxic"])], "SELECT d.doc_id AS documents_key, lang AS documents_lang, quality AS l_quality, toxic AS l_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", fields="lang", **_ALL)
joined("j3_inner_first_match", "customer", [("orders", "c_custkey", "o_custkey", "o", "inner", ["o_orderstatus", "o_totalprice"])], "SELECT c_custkey AS customer_key, c_name AS customer_c_name, o_orderstatus AS o_o_orderstatus, o_totalprice AS o_o_totalprice FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey", fields="c_name", **_ALL)
joined("j4_left_first_match", "nation", [("customer", "n_nationkey", "c_nationkey", "c", "left", ["c_name"])], "SELECT n_nationkey AS nation_key, n_name AS nation_n_name, c_name AS c_c_name FROM nation LEFT JOIN (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) ON n_nationkey = c_nationkey", fields="n_name", **_ALL)
joined("j6_star", "supplier", [("nation", "s_nationkey", "key", "n", "inner", ["n_name"]), ("region", "s_nationkey", "key", "r", "left", ["r_name"])], "SELECT s_suppkey AS supplier_key, s_name AS supplier_s_name, n_name AS n_n_name, r_name AS r_r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON s_nationkey = r_regionkey", fields="s_name", **_ALL)
joined("j7_self", "nation", [("nation", "n_regionkey", "key", "other", "left", ["n_name"])], "SELECT a.n_nationkey AS nation_key, a.n_name AS nation_n_name, b.n_name AS other_n_name FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey", fields="n_name", **_ALL)
joined("j10_join_limit", "orders", [("customer", "o_custkey", "key", "c", "inner", ["c_name"])], "SELECT o_orderkey AS orders_key, c_name AS c_c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 30 OFFSET 5", fields=[], limit=30, offset=5)
joined("j11_join_order", "orders", [("customer", "o_custkey", "key", "c", "inner", ["c_name"])], "SELECT o_orderkey AS orders_key, o_totalprice AS orders_o_totalprice, c_name AS c_c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30", fields="o_totalprice", order_by="o_totalprice", order="desc", limit=30)


def _composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    driver = table(spark, sf_dir, "lineitem")
    flags = adapt(driver.data.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines")), "flags", None, ["l_returnflag+l_linestatus"])
    df = Q.find(driver, [leaf("l_quantity", "eq", 50)], ["l_orderkey", "l_partkey"], 0, Q.ALL, joins=[JoinSpec(flags, "l_returnflag+l_linestatus", "l_returnflag+l_linestatus", "f", "inner", ("lines",))])
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


add("j5_composite", _composite_join, "SELECT l_orderkey AS lineitem_l_orderkey, l_partkey AS lineitem_l_partkey, lines AS f_lines FROM lineitem JOIN (SELECT l_returnflag r, l_linestatus s, count(*) AS lines FROM lineitem GROUP BY ALL) ON l_returnflag = r AND l_linestatus = s WHERE l_quantity = 50")


# aggregates


def aggregated(name: str, source: str, sql: str, **r: Any) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = A.aggregate(table(spark, sf_dir, source), **r)
        doubles = [c for c, kind in df.dtypes if kind == "double"]
        return df.withColumns({c: F.round(c, 2) for c in doubles}) if doubles else df  # sums of doubles depend on their order

    add(name, query, sql)


def fn(name: str, field: str | None = None, alias: str | None = None) -> dict:
    return {"fn": name, "field": field, "alias": alias}


aggregated("a1_count", "orders", "SELECT count(*) AS count, count(o_custkey) AS count_o_custkey FROM orders", specs=[fn("count"), fn("count", "o_custkey")])
aggregated("a2_sum", "lineitem", "SELECT round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem", specs=[fn("sum", "l_quantity")])
aggregated("a3_avg", "lineitem", "SELECT round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem WHERE l_returnflag = 'R'", specs=[fn("avg", "l_extendedprice")], criteria={"l_returnflag": "R"})
aggregated("a4_min", "orders", "SELECT round(min(o_totalprice), 2) AS min_o_totalprice, min(o_orderpriority) AS first_priority FROM orders", specs=[fn("min", "o_totalprice"), fn("min", "o_orderpriority", "first_priority")])
aggregated("a5_max", "orders", "SELECT round(max(o_totalprice), 2) AS max_o_totalprice, max(o_orderdate) AS max_o_orderdate FROM orders", specs=[fn("max", "o_totalprice"), fn("max", "o_orderdate")])
aggregated("a7_group_two_keys", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 2) AS disc FROM lineitem GROUP BY ALL", specs=[fn("count", None, "n"), fn("sum", "l_quantity", "qty"), fn("avg", "l_discount", "disc")], group_by="l_returnflag,l_linestatus")
aggregated("a7_group_composite", "lineitem", 'SELECT l_returnflag || l_linestatus AS "l_returnflag+l_linestatus", count(*) AS count FROM lineitem GROUP BY ALL', specs=[fn("count")], group_by="l_returnflag+l_linestatus")
aggregated("a8_global_empty", "orders", "SELECT count(*) AS count, sum(o_totalprice) AS sum_o_totalprice FROM orders WHERE o_orderstatus = 'nosuch'", specs=[fn("count"), fn("sum", "o_totalprice")], criteria={"o_orderstatus": "nosuch"})
aggregated("a9_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 12", specs=[fn("count", None, "n")], group_by="o_custkey", having=[leaf("n", "gte", 12)])
aggregated("a10_having_group_field", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING o_orderpriority > '2' AND count(*) > 1", specs=[fn("count", None, "n")], group_by="o_orderpriority", having=[leaf("o_orderpriority", "gt", "2"), leaf("n", "gt", 1)])
aggregated("a11_having_or", "customer", "SELECT c_nationkey, count(*) AS n, round(max(c_acctbal), 2) AS m FROM customer GROUP BY ALL HAVING count(*) > 70 OR max(c_acctbal) < 9800", specs=[fn("count", None, "n"), fn("max", "c_acctbal", "m")], group_by="c_nationkey", having={"or": [leaf("n", "gt", 70), leaf("m", "lt", 9800)]})
aggregated("a12_order_by_alias", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 10", specs=[fn("count", None, "n")], group_by="o_custkey", order_by="n", order="desc", limit=10)
aggregated("a13_group_limit", "events", "SELECT user_id, count(*) AS count FROM events GROUP BY ALL ORDER BY user_id LIMIT 20", specs=[fn("count")], group_by="user_id", limit=20)
aggregated("a14_count_only", "events", "SELECT count(*) AS count FROM events", specs=[fn("count")])
aggregated("a15_not_equal", "orders", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL", specs=[fn("count", None, "n"), fn("sum", "o_totalprice", "total")], group_by="o_orderstatus", criteria=[leaf("o_orderpriority", "neq", "5-LOW")])
aggregated("a17_composite_field", "customer", "SELECT max(try_cast(c_nationkey::VARCHAR || c_custkey::VARCHAR AS DOUBLE)) AS m FROM customer", specs=[fn("max", "c_nationkey+c_custkey", "m")])
aggregated("a18_dates", "orders", "SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY ALL", specs=[fn("min", "o_orderdate", "first"), fn("max", "o_orderdate", "last")], group_by="o_orderstatus")
add("a21_count_mode", on("lineitem", lambda t: Q.count(t, [leaf("l_shipdate", "gte", "19950601"), leaf("l_returnflag", "in", "A,N")])), "SELECT count(*) AS count FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_returnflag IN ('A', 'N')")


# writes and schemas, over an object loaded from a table


def engine(spark: SparkSession) -> Engine:
    """An engine in a fresh folder of the shared checkpoint location; local sessions may go without one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if top is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    top = top or tempfile.mkdtemp(prefix="engine_")
    return Engine(spark, f"{top}/engine_{uuid.uuid4().hex}")


def loaded(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark)
    specs = ["segment:varchar:16", "balance:numeric:12,2", "nation:int"]
    e.request({"mode": "create-object", "dir": "q", "object": "customers", "fields": specs, "indexes": ["segment"]})
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("_n"), F.array(F.lit("segment"), F.lit("balance"), F.lit("nation")).alias("_given"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"), F.col("c_nationkey").alias("nation"),
    )
    e.writer.bulk_insert("q", "customers", rows)
    return e


def after(*requests: dict) -> Query:
    """The object's rows after some requests."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = loaded(spark, sf_dir)
        for r in requests:
            out = e.request({"dir": "q", "object": "customers"} | r)
            if isinstance(out, dict) and "error" in out and not r.get("may_fail"):
                raise ValueError(out["error"])
        return e.catalog.table("q", "customers").data

    return query


_BASE = "SELECT c_custkey::VARCHAR AS key, c_mktsegment AS segment, c_acctbal::DECIMAL(12,2) AS balance, c_nationkey AS nation FROM customer"
add("w1_upsert", after({"mode": "insert", "key": "1", "value": {"segment": "NEW"}}, {"mode": "insert", "key": "x", "value": {"nation": 3}}), f"SELECT * FROM ({_BASE}) WHERE key <> '1' UNION ALL VALUES ('1', 'NEW', NULL, NULL), ('x', NULL, NULL, 3)")
add("w2_if_not_exists", after({"mode": "insert", "key": "1", "value": {"segment": "NEW"}, "if_not_exists": True, "may_fail": True}), _BASE)
add("w4_partial_update", after({"mode": "update", "key": "7", "value": {"segment": "X"}}), f"SELECT key, CASE WHEN key = '7' THEN 'X' ELSE segment END AS segment, balance, nation FROM ({_BASE})")
add("w5_delete", after({"mode": "delete", "key": "9"}), f"SELECT * FROM ({_BASE}) WHERE key <> '9'")
add("w6_condition", after({"mode": "update", "key": "7", "value": {"segment": "X"}, "if": [leaf("nation", "lt", "-1")], "may_fail": True}), _BASE)
add("w7_bulk_insert", after({"mode": "bulk-insert", "records": {"5": {"nation": 1}, "y": {"segment": "s", "balance": "1.5"}}}), f"SELECT * FROM ({_BASE}) WHERE key <> '5' UNION ALL VALUES ('5', NULL, NULL, 1), ('y', 's', 1.50, NULL)")
add("w9_bulk_delete_keys", after({"mode": "bulk-delete", "keys": ["1", "2", "nosuch"]}), f"SELECT * FROM ({_BASE}) WHERE key NOT IN ('1', '2')")
add("w10_delete_where", after({"mode": "bulk-delete", "criteria": [leaf("segment", "eq", "BUILDING")]}), f"SELECT * FROM ({_BASE}) WHERE segment <> 'BUILDING'")
add("w11_update_where", after({"mode": "bulk-update", "criteria": [leaf("balance", "lt", 0)], "value": {"segment": "DEBT"}}), f"SELECT key, CASE WHEN balance < 0 THEN 'DEBT' ELSE segment END AS segment, balance, nation FROM ({_BASE})")
add("w12_update_records", after({"mode": "bulk-update", "records": [{"key": "1", "value": {"nation": 99}}, {"key": "nosuch", "value": {"nation": 1}}]}), f"SELECT key, segment, balance, CASE WHEN key = '1' THEN 99 ELSE nation END AS nation FROM ({_BASE})")
add("d1_create_and_load", after(), _BASE)
add("d3_add_field", after({"mode": "add-field", "fields": ["note:varchar:20"]}, {"mode": "update", "key": "1", "value": {"note": "hi"}}), f"SELECT *, CASE WHEN key = '1' THEN 'hi' END AS note FROM ({_BASE})")
add("d4_rename_field", after({"mode": "rename-field", "old": "segment", "new": "market"}), f"SELECT key, segment AS market, balance, nation FROM ({_BASE})")
add("d5_remove_field", after({"mode": "remove-field", "fields": ["balance"]}), f"SELECT key, segment, nation FROM ({_BASE})")
add("d6_vacuum_compact", after({"mode": "remove-field", "fields": ["nation"]}, {"mode": "vacuum", "compact": True, "splits": 16}), f"SELECT key, segment, balance FROM ({_BASE})")
add("d7_truncate", after({"mode": "truncate"}), f"SELECT * FROM ({_BASE}) WHERE false")


# more writes, sources, sinks and discovery


def answered(ask: Callable[[Engine, SparkSession, str], DataFrame]) -> Query:
    """A query on the loaded object whose rows come from responses."""
    return lambda spark, sf_dir: ask(loaded(spark, sf_dir), spark, sf_dir)


def customers(e: Engine, mode: str, **r: Any) -> Any:
    out = e.request({"mode": mode, "dir": "q", "object": "customers"} | r)
    if isinstance(out, dict) and "error" in out:
        raise ValueError(out["error"])
    return out


def folder(e: Engine) -> str:
    return e.catalog.files.path("_exchange", uuid.uuid4().hex)


_NATION = ["name:varchar:25", "region:int"]


def _nations(spark: SparkSession, sf_dir: str, as_dict: bool) -> DataFrame:
    """The nations written as one JSON document and loaded from it."""
    e = engine(spark)
    e.request({"mode": "create-object", "dir": "q", "object": "nations", "fields": _NATION})
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key, value = F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    entries = F.collect_list(F.struct(key.alias("key"), value.alias("value")))  # 25 rows at any scale
    path = folder(e)
    n.agg(F.to_json(F.map_from_entries(entries) if as_dict else entries)).write.text(path)
    out = e.request({"mode": "bulk-insert", "dir": "q", "object": "nations", "file": path})
    if "error" in out:
        raise ValueError(out["error"])
    return e.catalog.table("q", "nations").data


_NATION_SQL = "SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey AS region FROM nation"
add("io1_json_dict", lambda spark, sf_dir: _nations(spark, sf_dir, True), _NATION_SQL)
add("io2_json_array", lambda spark, sf_dir: _nations(spark, sf_dir, False), _NATION_SQL)


def _delimited(mode: str) -> Query:
    """Lines made of all customers, loaded or applied as a patch (blank cells keep what is there)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = loaded(spark, sf_dir)
        path = folder(e)
        c = spark.read.parquet(f"{sf_dir}/customer.parquet")
        key = F.concat(F.lit("n" if mode == "bulk-insert-delimited" else ""), F.col("c_custkey").cast("string"))
        cells = key, F.lit("LOADED"), F.lit(""), (F.col("c_nationkey") + 1).cast("string")
        c.select(F.concat_ws("|", *cells)).write.text(path)
        customers(e, mode, file=path, delimiter="|")
        return e.catalog.table("q", "customers").data

    return query


add("io3_delimited", _delimited("bulk-insert-delimited"), f"{_BASE} UNION ALL SELECT 'n' || c_custkey, 'LOADED', NULL, c_nationkey + 1 FROM customer")
add("w8_bulk_insert_delimited", _delimited("bulk-insert-delimited"), _oracle["io3_delimited"])
add("w13_bulk_update_delimited", _delimited("bulk-update-delimited"), f"SELECT key, 'LOADED' AS segment, balance, nation + 1 AS nation FROM ({_BASE})")
add("w3_insert_if", after({"mode": "insert", "key": "7", "value": {"nation": 5}, "if": [leaf("segment", "neq", "nosuch")]}, {"mode": "insert", "key": "8", "value": {"nation": 5}, "if": [leaf("segment", "eq", "nosuch")], "may_fail": True}), f"SELECT * FROM ({_BASE}) WHERE key <> '7' UNION ALL VALUES ('7', NULL, NULL, 5)")
add("w15_defaults", after({"mode": "add-field", "fields": ["origin:varchar:9:default=web", "serial:long:default=seq(s)"]}, {"mode": "insert", "key": "d1", "value": {"nation": 1}}, {"mode": "insert", "key": "d2", "value": {"origin": "mail"}}), f"SELECT *, NULL::VARCHAR AS origin, NULL::BIGINT AS serial FROM ({_BASE}) UNION ALL VALUES ('d1', NULL, NULL, 1, 'web', 1), ('d2', NULL, NULL, NULL, 'mail', 2)")


def _sequence(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    act = lambda action, **r: customers(e, "sequence", name="s", action=action, **r)
    seen = [act("next")["value"], act("next-batch", batch=10)["end"], act("current")["value"], act("reset", value=5)["value"], act("next")["value"]]
    return spark.createDataFrame(list(enumerate(seen)), "step long, value long")


add("w14_sequence", answered(_sequence), "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (1, 11), (2, 11), (3, 5), (4, 6)) v(step, value)")


def _written_csv(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    data, path = e.catalog.table("q", "customers").data, folder(e)
    formats.write_csv(data, path, ";")
    return spark.read.schema(data.schema).option("header", True).option("sep", ";").option("escape", '"').csv(path)


def _written_json(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    data, path = e.catalog.table("q", "customers").data, folder(e)
    formats.write_json(data, path, "key")
    kind = "key string, value struct<segment:string, balance:decimal(12,2), nation:int>"
    return spark.read.text(path).select(F.from_json("value", kind).alias("r")).select("r.key", "r.value.*")


add("io4_json_records", answered(_written_json), _BASE)
add("io7_csv", answered(_written_csv), _BASE)


def _rows(form: str) -> Query:
    def ask(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
        r = {"criteria": [leaf("nation", "eq", 3)], "order_by": "balance", "limit": 40, "fields": ["nation", "segment"], "format": form}
        out = customers(e, "find", **r)
        if form == "dict":
            rows = [(k, v["nation"], v["segment"]) for k, v in out.items()]
        elif form == "rows":
            rows = [tuple(x) for x in out["rows"]]
        else:
            rows = [(k, int(n), s) for k, n, s in (x.split(",") for x in out.splitlines()[1:])]
        return spark.createDataFrame(rows, "key string, nation int, segment string")

    return answered(ask)


_PAGE_SQL = f"SELECT key, nation, segment FROM ({_BASE}) WHERE nation = 3 ORDER BY balance, key LIMIT 40"
add("io5_rows", _rows("rows"), _PAGE_SQL)
add("io6_dict", _rows("dict"), _PAGE_SQL)
add("io7_csv_response", _rows("csv"), _PAGE_SQL)


def _joined_csv(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    e.request({"mode": "create-object", "dir": "q", "object": "nations", "fields": _NATION})
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # 25 rows at any scale
    e.request({"mode": "bulk-insert", "dir": "q", "object": "nations", "records": {str(r[0]): {"name": r[1], "region": r[2]} for r in n if r[0] != 4}})
    customers(e, "add-field", fields=["home:varchar:9"])
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    e.writer.bulk_update("q", "customers", ids.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("_n"), F.array(F.lit("home")).alias("_given"), *(F.lit(None).cast(t).alias(c) for c, t in (("segment", "string"), ("balance", "decimal(12,2)"), ("nation", "int"))), (F.col("c_custkey") % 5).cast("string").alias("home")))
    r = {"mode": "find", "dir": "q", "object": "customers", "criteria": [leaf("home", "exists")], "fields": "home", "limit": Q.ALL, "join": [{"object": "nations", "local": "home", "remote": "key", "as": "n", "type": "left", "fields": ["name"]}]}
    path = folder(e)
    formats.write_csv(e.frame(r), path)
    return spark.read.schema("key string, home string, name string").option("header", True).csv(path)


add("io8_joined_csv", answered(_joined_csv), "SELECT c_custkey::VARCHAR AS key, (c_custkey % 5)::VARCHAR AS home, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 5 AND n_nationkey <> 4")


def _files(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    for i in range(3):
        customers(e, "put-file", filename=f"part-{i}.txt", data=base64.b64encode(b"x" * (10 * i + 1)).decode())
    customers(e, "put-file", filename="other.bin", data="")
    customers(e, "delete-file", filename="part-1.txt")
    listed = customers(e, "list-files", prefix="part-")["files"]
    found = e.blobs.frame("q", "customers").select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length")
    return found.where(F.col("filename").isin(listed))


add("io9_files", answered(_files), "SELECT * FROM (VALUES ('part-0.txt', 1::BIGINT), ('part-2.txt', 21)) v(filename, length)")
add("io10_manifest", answered(lambda e, spark, _: spark.createDataFrame([(o["object"], f) for o in e.request({"mode": "export-schema", "dir": "q"})["objects"] for f in o["fields"]], "object string, field string")), "SELECT 'customers' AS object, unnest(['segment:varchar:16', 'balance:numeric:12,2', 'nation:int']) AS field")
add("io11_backup", answered(lambda e, spark, _: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(customers(e, "backup")["path"] + "/data").select("key", "segment", "balance", "nation")), _BASE)
add("d2_drop", answered(lambda e, spark, _: spark.createDataFrame([(customers(e, "drop-object")["status"], customers(e, "drop-object", if_exists=True)["status"], len(e.request({"mode": "list-objects", "dir": "q"})))], "first string, second string, left long")), "SELECT 'dropped' AS first, 'not_found' AS second, 0::BIGINT AS \"left\"")
add("d8_recount", answered(lambda e, spark, _: spark.createDataFrame([(customers(e, "recount")["count"], customers(e, "size"), customers(e, "orphaned"))], "recount long, size long, orphaned long")), "SELECT count(*) AS recount, count(*) AS size, 0::BIGINT AS orphaned FROM customer")
add("sc15_orphaned", answered(lambda e, spark, _: spark.createDataFrame([(customers(e, "bulk-delete", keys=["1", "2"])["deleted"], customers(e, "orphaned"), customers(e, "size"))], "deleted long, orphaned long, size long")), "SELECT 2::BIGINT AS deleted, 0::BIGINT AS orphaned, count(*) - 2 AS size FROM customer")


def _indexes(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    customers(e, "add-index", fields=["nation", "segment+nation"])
    customers(e, "rename-field", old="nation", new="country")
    customers(e, "remove-index", field="segment")
    customers(e, "reindex")
    return spark.createDataFrame([(x,) for x in customers(e, "describe-object")["indexes"]], "name string")


add("d9_indexes", answered(_indexes), "SELECT unnest(['country', 'segment+country']) AS name")
add("d11_describe", answered(lambda e, spark, _: spark.createDataFrame([(f["name"], f["type"], f["size"]) for f in customers(e, "describe-object")["fields"]], "name string, type string, size long")), "SELECT * FROM (VALUES ('segment', 'varchar', 18::BIGINT), ('balance', 'numeric', 8), ('nation', 'int', 4)) v(name, type, size)")
add("d12_dirs", answered(lambda e, spark, _: spark.createDataFrame([(d,) for _ in [e.request({"mode": "add-dir", "dir": "r"}), e.request({"mode": "add-dir", "dir": "s"}), e.request({"mode": "remove-dir", "dir": "s"})][:1] for d in e.request({"mode": "db-dirs"})], "dir string")), "SELECT unnest(['q', 'r']) AS dir")
add("d13_shard_stats", answered(lambda e, spark, _: spark.createDataFrame([(len(s["shards"]), sum(x["active"] for x in s["shards"])) for s in [customers(e, "shard-stats")]], "shards long, active long")), "SELECT 8::BIGINT AS shards, count(*) AS active FROM customer")


def _cursor_walk(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through one segment until the cursor ends; excluded keys are in no page."""
    seen, cursor = [], None
    while True:
        page = customers(e, "find", criteria=[leaf("nation", "eq", 7)], order_by="segment", cursor=cursor, limit=25, fields="nation", excludedKeys=["3", "5"])
        seen += [(x["key"], x["value"]["nation"]) for x in page["rows"]]
        cursor = page["cursor"]
        if cursor is None:
            return spark.createDataFrame(seen, "key string, nation int")


add("c5_cursor_walk", answered(_cursor_walk), f"SELECT key, nation FROM ({_BASE}) WHERE nation = 7 AND key NOT IN ('3', '5')")
add("c6_cursor_excluded", on("orders", lambda t: Q.cursor_page(t, "o_totalprice", None, 20, excluded=[1, 2, 3], fields=[])), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (1, 2, 3) ORDER BY o_totalprice, o_orderkey LIMIT 20")
add("s4_absent_first", answered(lambda e, spark, _: (customers(e, "insert", key="none", value={"nation": 1}), Q.find(e.catalog.table("q", "customers"), order_by="balance", limit=10, fields="balance"))[1]), f"SELECT key, balance FROM ({_BASE} UNION ALL VALUES ('none', NULL, NULL, 1)) ORDER BY balance NULLS FIRST, key LIMIT 10")
aggregated("a6_default_alias", "orders", "SELECT o_orderstatus, count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY ALL", specs=["count", "sum(o_totalprice)"], group_by=["o_orderstatus"])
add("a19_csv", answered(lambda e, spark, _: spark.createDataFrame([(s, int(n)) for s, n in (x.split(",") for x in customers(e, "aggregate", aggregates=[fn("count", None, "n")], group_by="segment", format="csv").splitlines()[1:])], "segment string, n long")), "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL")


def _errors(*requests: dict) -> Query:
    """The texts with which requests are refused, by step; an answer that isn't an error is "-"."""

    def ask(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = []
        for r in requests:
            e.guarded = bool(r.get("ip"))
            out = e.request({"dir": "q", "object": "customers"} | {k: v for k, v in r.items() if k != "ip"}, r.get("ip"))
            texts.append(out["error"] if isinstance(out, dict) and "error" in out else "-")
        e.guarded = False
        return spark.createDataFrame(list(enumerate(texts)), "step long, error string")

    return answered(ask)


def _texts(*texts: str) -> str:
    rows = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(x.replace("'", "''") for x in texts))
    return f"SELECT * FROM (VALUES {rows}) v(step, error)"


_FIND, _AGG = {"mode": "find"}, {"mode": "aggregate"}
_JOIN = {"object": "customers", "local": "segment", "remote": "key", "as": "x"}
_DEEP: dict = leaf("segment", "eq", "x")
for _ in range(17):
    _DEEP = {"and": [_DEEP]}
add("pr6_timeout", _errors({"mode": "count", "criteria": {"segment": "BUILDING"}, "timeout_ms": 600000}, {"mode": "find", "criteria": {"segment": "BUILDING"}, "timeout_ms": 1}), _texts("-", "timeout"))
add("f44_errors", _errors(*(_FIND | {"criteria": c} for c in ([leaf("segment", "nosuch", 1)], [{"op": "eq", "value": 1}], [leaf("nation", "between", 1)], {"or": []}, _DEEP, [5], "{bad", 5, [leaf("nation", "gt", "abc")]))), _texts("unknown operator: nosuch", "criterion without a field", "between needs value and value2", "empty or", "criteria are nested deeper than 16", "a criterion must be an object", "criteria aren't valid JSON", "criteria must be an array or an object", "bad int value for nation: 'abc'"))
add("j9_join_errors", _errors(*(_FIND | {"join": [_JOIN | x]} for x in ({"as": "customers"}, {"local": "nosuch"}, {"remote": "nosuch"}, {"remote": "nation"}, {"fields": ["nosuch"]}, {"fields": ["segment+nation"]}, {"object": "nosuch"}, {"local": None})), _FIND | {"join": [_JOIN], "format": "dict"}), _texts("join alias customers is taken", "join: unknown local field nosuch", "join: unknown remote field nosuch", "join: remote field nation is neither the key nor indexed", "join: unknown field nosuch of customers", "join: composite fields can't be projected", "unknown object: q/nosuch", "a join needs object, local and remote", "format=dict is not supported with join"))
add("s5_unknown_order", _errors(_FIND | {"order_by": "nosuch"}, _AGG | {"group_by": "segment", "aggregates": [fn("count")], "order_by": "nosuch"}), _texts("unknown order_by field: nosuch", "order_by names neither a group field nor an aggregate: nosuch"))
add("c4_cursor_errors", _errors(*(_FIND | {"cursor": None} | x for x in ({}, {"order_by": "nation"}, {"order_by": "nosuch"}, {"order_by": "segment", "join": [_JOIN]}, {"order_by": "segment", "format": "csv"}, {"order_by": "segment", "cursor": {"segment": "a"}}, {"order_by": "segment", "offset": 2}))), _texts("cursor requires order_by", "cursor requires an indexed order_by field: nation", "unknown order_by field: nosuch", "cursor is not supported with join", "cursor is not supported with csv", "cursor must hold segment and key", "offset is not supported with cursor"))
add("a20_many_aggregates", _errors(*(_AGG | {"aggregates": [fn("sum", "nation", f"a{i}") for i in range(n)]} for n in (32, 33))), _texts("-", "more than 32 aggregates"))
add("d14_access", _errors({"mode": "add-token", "token": "reader-000", "perm": "r"}, {"mode": "add-token", "token": "admin-of-r", "dir": "r", "object": None, "perm": "rwx"}, *({"auth": a, "ip": "10.0.0.9"} | r for a, r in (("nosuch", {"mode": "size"}), ("reader-000", {"mode": "size"}), ("reader-000", {"mode": "truncate"}), ("admin-of-r", {"mode": "size"}), ("admin-of-r", {"mode": "stats"}))), {"mode": "remove-token", "token": "nosuch"}), _texts("-", "-", "auth failed", "-", "permission denied", "permission denied", "permission denied", "unknown token"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment of open or urgent orders: filter, lookup join, group, having, top 3."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    criteria = [leaf("o_orderstatus", "in", "O,F"), {"or": [leaf("o_totalprice", "gt", 100000), leaf("o_orderpriority", "starts", "1")]}]
    df = Q.find(orders, criteria, ["o_totalprice"], 0, Q.ALL, joins=[JoinSpec(customer, "o_custkey", "c_custkey", "c", "inner", ("c_mktsegment",))])
    flat = adapt(df.toDF("key", "price", "segment"), "flat", "key")
    out = A.aggregate(flat, [fn("count", None, "n"), fn("sum", "price", "revenue")], "segment", None, [leaf("n", "gt", 1)], "revenue", "desc", 3)
    return out.withColumn("revenue", F.round("revenue", 2))


add("flagship", flagship, "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') AND (o_totalprice > 100000 OR starts_with(o_orderpriority, '1')) GROUP BY ALL HAVING count(*) > 1 ORDER BY sum(o_totalprice) DESC LIMIT 3")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
