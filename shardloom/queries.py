"""Registered queries of the engine: SQL over logical sharded tables, each with the SQL that the unsharded tables answer."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.config import KeyGenerator, ReadWriteSplit, Strategy, TableRule
from shardloom.engine import Engine
from shardloom.functions import keys
from shardloom.functions.algorithms import hinted
from shardloom.operators.merge import Aggregate, Context, Order, merge
from shardloom.plans import analysis, planning
from shardloom.plans.router import DS, TBL
from shardloom.rw import Splitter

#: Logical table: base table, node expression, strategies by source and by table.
LAYOUT: dict[str, tuple[str, str, Strategy | None, Strategy | None]] = {
    "t_user": ("customer", "ds_${0..1}.t_user", Strategy("c_custkey", "ds_${c_custkey % 2}"), None),
    "t_order": ("orders", "ds_${0..1}.t_order_${0..3}", Strategy("o_custkey", "ds_${o_custkey % 2}"), Strategy("o_orderkey", "t_order_${o_orderkey % 4}")),
    "t_order_item": ("lineitem", "ds_${0..1}.t_order_item_${0..1}", Strategy("l_orderkey", "ds_${l_orderkey % 2}"), Strategy("l_orderkey", "t_order_item_${l_orderkey % 2}")),
    "t_event": ("events", "ds_${0..1}.t_event_${0..3}", Strategy("user_id", "2", "mod"), Strategy("event_type", "4", "hash_mod")),
    "t_part": ("part", "ds_0.t_part_${0..2}", None, Strategy("p_partkey", "0-500:t_part_0,501-1000:t_part_1,1001-9000000000000:t_part_2", "range")),
    "t_supply": ("supplier", "ds_${0..2}.t_supply", Strategy("s_suppkey, s_nationkey", "ds_${(s_suppkey % 3 + s_nationkey) % 3}", "complex_inline"), None),
}
PLAIN = ("nation", "region")
BASE = {name: base for name, (base, *_) in LAYOUT.items()}


def rules() -> dict[str, TableRule]:
    return {n: TableRule(n, nodes, ds, tbl) for n, (_, nodes, ds, tbl) in LAYOUT.items()}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def engine(spark: SparkSession, sf_dir: str, dialect: str = "postgresql", only: set[str] | None = None) -> Engine:
    """Logical tables over the input, their nodes worked out on the fly."""
    e = Engine(spark, rules(), dialect)
    for name, base in BASE.items():
        if only is None or name in only:
            e.attach(name, read(spark, sf_dir, base))
    for name in PLAIN:
        if only is None or name in only:
            e.register(name, read(spark, sf_dir, name))
    return e


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: the shared one the session names, or a local one on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="shardloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _literal(x: Any) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _plain(sql: str, args: tuple) -> str:
    """The same statement on the base tables, arguments written out."""
    sql = re.sub(r"\$(\d+)", lambda m: _literal(args[int(m[1]) - 1]), sql)
    return re.sub(r"\b(" + "|".join(sorted(BASE, key=len, reverse=True)) + r")\b(?!\s*\.)", lambda m: BASE[m[1]], sql)


def add(name: str, sql: str, oracle: str | None = None, args: tuple = (), dialect: str = "postgresql") -> None:
    """oracle: by default the same SQL on the base tables; None-like '' leaves it out."""
    words = set(re.findall(r"\w+", sql))
    only = {t for t in (*BASE, *PLAIN) if t in words}
    _QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, dialect, only).sql(sql, *args)
    if oracle != "":
        _ORACLES[name] = oracle or _plain(sql, args)


def query(name: str, oracle: str | None = None):
    def deco(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return deco


def money(x: str) -> str:
    return f"cast(sum(cast({x} AS decimal(18,2))) AS double)"


def mean(x: str) -> str:
    return f"{money(x)} / count({x})"


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"

# -- routing --
add("route_eq_ds", f"SELECT {_ORDER} FROM t_order WHERE o_custkey = $1", args=(7,))
add("route_eq_ds_tbl", f"SELECT {_ORDER} FROM t_order WHERE o_custkey = $1 OR (o_custkey = 10 AND o_orderkey = $2)", args=(13, 4))
add("route_in", f"SELECT {_ORDER} FROM t_order WHERE o_custkey IN (1, 3, 5, 7)")
add("route_between", "SELECT p_partkey, p_name, p_size FROM t_part WHERE p_partkey BETWEEN 490 AND 510")
add("route_broadcast", "SELECT o_orderstatus, count(*) AS n FROM t_order GROUP BY o_orderstatus")
add("route_inline_suffix", "SELECT c_custkey, c_name FROM t_user WHERE c_custkey = 42")
add("route_complex_inline", "SELECT s_suppkey, s_name FROM t_supply WHERE s_suppkey = 7 AND s_nationkey >= 0")
add("route_join_propagated", "SELECT u.c_custkey, u.c_name, o.o_orderkey FROM t_user u JOIN t_order o ON u.c_custkey = o.o_custkey WHERE u.c_custkey = 10")
add("hash_mod_event", "SELECT event_id, user_id, value FROM t_event WHERE event_type = 'click'")
add("mod_event_user", "SELECT event_id, event_type FROM t_event WHERE user_id = 3")


@query("hint_route", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 4 = 2")
def _hint_route(spark, sf_dir):
    e = engine(spark, sf_dir, only={"t_order"})
    with hinted(database="ds_1", table="t_order_2"):
        return e.sql("SELECT o_orderkey, o_custkey FROM t_order")


@query("shard_histogram", "SELECT 'ds_' || (o_custkey % 2) AS ds, 't_order_' || (o_orderkey % 4) AS tbl, count(*) AS n FROM orders GROUP BY 1, 2")
def _shard_histogram(spark, sf_dir):
    found = engine(spark, sf_dir, only={"t_order"}).logical["t_order"].frame()
    return found.groupBy(F.col(DS).alias("ds"), F.col(TBL).alias("tbl")).agg(F.count("*").alias("n"))


@query("mod_negative", "SELECT c_custkey, 'ds' || (c_custkey % 4) AS node FROM customer")
def _mod_negative(spark, sf_dir):
    from shardloom.functions.algorithms import create

    mod = create("mod", "4", ["k"])
    targets = [f"ds{i}" for i in range(4)]
    return read(spark, sf_dir, "customer").select("c_custkey", mod.column({"k": -F.col("c_custkey")}, targets).alias("node"))


@query("store_point_route", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def _store_point_route(spark, sf_dir):
    e = Engine(spark, rules(), "postgresql")
    e.attach_store("t_order", scratch(spark, "store"), read(spark, sf_dir, "orders"))
    return e.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM t_order WHERE o_custkey = $1", 7)


@query("union_nodes", f"SELECT o_orderstatus, count(*) AS n, {money('o_totalprice')} AS total FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1")
def _union_nodes(spark, sf_dir):
    """One DataFrame a node, as separate physical tables would be; only the routed ones are read."""
    e = Engine(spark, rules(), "postgresql")
    orders = e.router["t_order"].dealt(read(spark, sf_dir, "orders"))
    e.attach_nodes("t_order", {n: orders.where((F.col(DS) == n.source) & (F.col(TBL) == n.table)).drop(DS, TBL) for n in e.router["t_order"].nodes})
    with hinted(database="ds_0"):
        return e.sql(f"SELECT o_orderstatus, count(*) AS n, {money('o_totalprice')} AS total FROM t_order GROUP BY o_orderstatus")


# -- merge --
add("union_all_shards", "SELECT o_orderkey, o_custkey FROM t_order")
add("merge_sort_multi", "SELECT o_orderstatus, o_orderkey FROM t_order ORDER BY o_orderstatus ASC, o_orderkey DESC LIMIT 25")
add("merge_sort_desc_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM t_order ORDER BY st DESC NULLS LAST, o_orderkey")
add("merge_count", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_open FROM t_order")
add("merge_sum", f"SELECT {money('o_totalprice')} AS total FROM t_order")
add("merge_avg_weighted", f"SELECT o_orderpriority, {mean('o_totalprice')} AS avg_price FROM t_order GROUP BY o_orderpriority")
add("merge_min_max", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day, max(o_orderpriority) AS p FROM t_order")
add("merge_group_multi", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {money('o_totalprice')} AS total FROM t_order GROUP BY o_orderstatus, o_orderpriority")
add("merge_limit_offset", "SELECT o_orderkey FROM t_order ORDER BY o_orderkey LIMIT $1 OFFSET $2", args=(10, 20))
add("merge_limit_past_end", "SELECT o_orderkey FROM t_order ORDER BY o_orderkey LIMIT 10 OFFSET 2000000000")
add("merge_topk", f"SELECT o_custkey, {money('o_totalprice')} AS total FROM t_order GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10")
add("merge_global_agg", f"SELECT count(*) AS n, {money('l_extendedprice')} AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM t_order_item")


@query("merge_partials", f"SELECT o_orderstatus, count(*) AS n, {money('o_totalprice')} AS total, {mean('o_totalprice')} AS mean FROM orders GROUP BY 1")
def _merge_partials(spark, sf_dir):
    orders = engine(spark, sf_dir, only={"t_order"}).logical["t_order"].frame()
    shards = [orders.where(F.col(DS) == ds).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.avg(F.col("o_totalprice")).alias("mean")) for ds in ("ds_0", "ds_1")]
    out = merge(shards, Context(["o_orderstatus"], [Aggregate("count", "n"), Aggregate("sum", "total"), Aggregate("avg", "mean", "n")], [Order("o_orderstatus")]))
    # count feeds the weight too, so the mean is taken from the merged total.
    return out.select("o_orderstatus", "n", F.col("total").cast("double").alias("total"), (F.col("total").cast("double") / F.col("n")).alias("mean"))


# -- aggregates --
add("count_distinct", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS m FROM t_order")
add("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM t_order")
add("group_by_expr_day", "SELECT CAST(CAST(date_trunc('day', o_orderdate) AS date) AS text) AS d, count(*) AS n FROM t_order GROUP BY CAST(date_trunc('day', o_orderdate) AS date)")
add("having", f"SELECT o_custkey, count(*) AS n FROM t_order GROUP BY o_custkey HAVING count(*) > 12 AND {money('o_totalprice')} > 1000")
add("array_agg_sorted", "SELECT o_custkey, array_to_string(array_sort(array_agg(o_orderkey)), ',') AS ks FROM t_order GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(array_agg(o_orderkey)), ',') AS ks FROM orders GROUP BY o_custkey")
add("string_agg", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("json_agg", "SELECT r_regionkey, jsonb_agg(r_name) AS names FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '[\"' || r_name || '\"]' AS names FROM region")
add("coalesce_sum", f"SELECT c.c_custkey, coalesce({money('o.o_totalprice')}, 0) AS spent, count(o.o_orderkey) AS n FROM t_user c LEFT JOIN t_order o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
add("case_level", f"SELECT o_custkey, CASE WHEN {money('o_totalprice')} > 300000 THEN 'gold' WHEN {money('o_totalprice')} > 100000 THEN 'silver' ELSE 'bronze' END AS level FROM t_order GROUP BY o_custkey")

# -- joins --
add("join_inner", "SELECT u.c_name, o.o_orderkey FROM t_user u JOIN t_order o ON u.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000")
add("join_left", "SELECT u.c_custkey, coalesce(o.o_orderkey, -1) AS o_orderkey FROM t_user u LEFT JOIN t_order o ON u.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
add("join_right", "SELECT u.c_custkey, coalesce(o.o_orderkey, -1) AS o_orderkey FROM t_order o RIGHT JOIN t_user u ON u.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
add("join_full", "SELECT coalesce(n.n_name, '-') AS n_name, coalesce(s.s_suppkey, -1) AS s_suppkey FROM t_supply s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_suppkey < 20")
add("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
add("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
add("join_using", "SELECT a.o_orderkey, a.o_custkey, b.o_totalprice FROM t_order a JOIN t_order b USING (o_orderkey)")
add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("join_three_way", "SELECT n.n_name, count(*) AS n FROM t_order o JOIN t_user u ON o.o_custkey = u.c_custkey JOIN nation n ON u.c_nationkey = n.n_nationkey GROUP BY n.n_name")
add("join_four_way", f"SELECT r.r_name, count(*) AS n, {money('o.o_totalprice')} AS total FROM t_order o JOIN t_user u ON o.o_custkey = u.c_custkey JOIN nation n ON u.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
add("join_semi_in", "SELECT c_custkey FROM t_user WHERE c_custkey IN (SELECT o_custkey FROM t_order WHERE o_totalprice > 150000)")
add("join_anti_not_exists", "SELECT u.c_custkey FROM t_user u WHERE NOT EXISTS (SELECT 1 FROM t_order o WHERE o.o_custkey = u.c_custkey AND o.o_totalprice > 250000)")
add("join_cte", "WITH s AS (SELECT o_custkey, count(*) AS n FROM t_order GROUP BY o_custkey) SELECT u.c_name, s.n FROM t_user u JOIN s ON s.o_custkey = u.c_custkey WHERE s.n > 10")
add("join_binding_tables", f"SELECT o.o_orderstatus, count(*) AS n, {money('i.l_extendedprice')} AS total FROM t_order o JOIN t_order_item i ON o.o_orderkey = i.l_orderkey GROUP BY o.o_orderstatus")

# -- windows --
add("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rn FROM t_order")
add("win_rank", "SELECT n_name, CAST(rank() OVER (ORDER BY n_regionkey) AS bigint) AS r FROM nation")
add("win_dense_rank", "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS bigint) AS r FROM t_order")
add("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM t_order")
add("win_avg_all", "SELECT r_regionkey, avg(r_regionkey) OVER () AS a FROM region")
add("win_avg_part", "SELECT n_nationkey, avg(n_nationkey) OVER (PARTITION BY n_regionkey) AS a FROM nation")
add("win_count_part", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM t_order")
add("win_over_agg", "SELECT o_custkey, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS bigint) AS rn FROM t_order GROUP BY o_custkey")
add("win_rows_frame", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM t_order")
add("win_range_frame", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM nation")

# -- subqueries and CTEs --
add("sub_scalar_corr", "SELECT u.c_custkey, (SELECT count(*) FROM t_order o WHERE o.o_custkey = u.c_custkey) AS n FROM t_user u")
add("sub_in_distinct", "SELECT c_custkey, c_name FROM t_user WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM t_order WHERE o_orderstatus = 'P')")
add("sub_exists", "SELECT u.c_custkey FROM t_user u WHERE EXISTS (SELECT 1 FROM t_order o WHERE o.o_custkey = u.c_custkey AND o.o_totalprice > 200000)")
add("sub_comparison", "SELECT o_orderkey FROM t_order WHERE o_totalprice > (SELECT max(c_acctbal) * 20 FROM t_user)")
add("sub_derived_nested", "SELECT k, n FROM (SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM t_order WHERE o_orderstatus = 'O') a GROUP BY k) b WHERE n > 1")
add("cte_multi", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM t_order GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n >= 10) SELECT a.k, a.n FROM a JOIN b ON a.k = b.k")
add("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS bigint) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t")
add("sub_string_agg_limited", "SELECT r.r_name, (SELECT string_agg(x.n_name, ',') FROM (SELECT n_name FROM nation WHERE n_name < 'D' ORDER BY n_name LIMIT 1) x) AS names FROM region r")
add("user_order_summary", f"SELECT u.c_custkey AS user_id, u.c_name AS username, count(o.o_orderkey) AS total_orders, coalesce({money('o.o_totalprice')}, 0) AS total_spent, {mean('o.o_totalprice')} AS avg_order_value, max(o.o_orderdate) AS last_order_date FROM t_user u LEFT JOIN t_order o ON u.c_custkey = o.o_custkey GROUP BY u.c_custkey, u.c_name", f"SELECT u.c_custkey AS user_id, u.c_name AS username, count(o.o_orderkey) AS total_orders, coalesce({money('o.o_totalprice')}, 0) AS total_spent, CASE WHEN count(o.o_totalprice) > 0 THEN {mean('o.o_totalprice')} END AS avg_order_value, max(o.o_orderdate) AS last_order_date FROM customer u LEFT JOIN orders o ON u.c_custkey = o.o_custkey GROUP BY u.c_custkey, u.c_name")

# -- set operations --
add("set_union_distinct", "SELECT o_custkey AS k FROM t_order UNION SELECT c_custkey FROM t_user")
add("set_union_all", "SELECT o_custkey AS k FROM t_order UNION ALL SELECT c_custkey FROM t_user")

# -- scalars --
add("fn_coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st FROM t_order")
add("fn_greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax, 10) AS g, least(l_quantity, 10) AS l FROM t_order_item")
add("fn_concat", "SELECT c_custkey, c_name || ':' || c_mktsegment AS x FROM t_user")
add("fn_like", "SELECT p_partkey FROM t_part WHERE p_name LIKE '%a%'")
add("fn_ilike", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
add("fn_similar_to", "SELECT n_name FROM nation WHERE n_name SIMILAR TO '(A|NATION_1)%'", "SELECT n_name FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE 'NATION\\_1%' ESCAPE '\\'")
add("fn_regex_match", "SELECT n_name FROM nation WHERE n_name ~ '[0-3]$'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '[0-3]$')")
add("fn_regex_imatch", "SELECT c_custkey FROM t_user WHERE c_mktsegment ~* '^a' AND c_name !~ '9$' AND c_name !~* 'X'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^a', 'i') AND NOT regexp_matches(c_name, '9$') AND NOT regexp_matches(c_name, 'X', 'i')")
add("fn_json_text", "SELECT event_id, props->>'k' AS k FROM t_event", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
add("fn_json_path", "SELECT event_id, CAST(props #>> '{k}' AS int) + 1 AS k FROM t_event", "SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS int) + 1 AS int) AS k FROM events")
add("fn_json_contains", "SELECT event_id FROM t_event WHERE props @> '{\"k\": 7}'", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
add("fn_json_key_exists", "SELECT event_id FROM t_event WHERE props ? 'k'", "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k')")
add("fn_json_keys_any", "SELECT count(*) AS n FROM t_event WHERE props ?| ARRAY['k', 'z'] AND props ?& ARRAY['k']", "SELECT count(*) AS n FROM events WHERE list_contains(json_keys(props), 'k')")
add("fn_array_any", "SELECT o_orderkey FROM t_order WHERE o_orderstatus = ANY(ARRAY['F', 'P'])", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
add("fn_array_overlap", "SELECT n_name FROM nation WHERE ARRAY[n_regionkey] && ARRAY[1, 3]", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
add("fn_array_contains_all", "SELECT n_name FROM nation WHERE ARRAY[n_regionkey, n_nationkey] @> ARRAY[2]", "SELECT n_name FROM nation WHERE n_regionkey = 2 OR n_nationkey = 2")
add("fn_array_contained", "SELECT n_name FROM nation WHERE ARRAY[n_regionkey] <@ ARRAY[0, 1]", "SELECT n_name FROM nation WHERE n_regionkey IN (0, 1)")
add("fn_array_append", "SELECT n_name, array_to_string(array_append(ARRAY[n_regionkey], n_nationkey), '-') AS a FROM nation", "SELECT n_name, n_regionkey || '-' || n_nationkey AS a FROM nation")
add("fn_array_to_string", "SELECT r_name, ARRAY_TO_STRING(ARRAY[r_name, 'x'], '/') AS a FROM region", "SELECT r_name, r_name || '/x' AS a FROM region")
add("fn_unnest", "SELECT r_name, unnest(ARRAY[1, 2, r_regionkey]) AS v FROM region", "SELECT r_name, unnest([1, 2, r_regionkey]) AS v FROM region")
add("fn_generate_series", "SELECT generate_series(1, 9, 2) AS v", "SELECT CAST(unnest(generate_series(1, 9, 2)) AS int) AS v")
add("fn_date_trunc", "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS date) AS text) AS m, count(*) AS n FROM t_order GROUP BY 1")
add("fn_interval_filter", "SELECT o_orderkey FROM t_order WHERE o_orderdate > (SELECT max(o_orderdate) FROM t_order) - INTERVAL '30 days'")
add("fn_mysql_date_sub", "SELECT o_orderkey FROM t_order WHERE o_orderdate >= DATE_SUB(CAST('1998-01-31' AS timestamp), INTERVAL 30 DAY)", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'", dialect="mysql")
add("fn_now", "SELECT count(*) AS n FROM t_order WHERE o_orderdate < NOW() AND CURRENT_DATE > CAST('2000-01-01' AS date)", "SELECT count(*) AS n FROM orders")
add("fn_cast_pg", "SELECT o_orderkey::text AS k, o_totalprice::numeric(18,2)::float8 AS p, '5.5'::numeric::float8 AS h FROM t_order", "SELECT CAST(o_orderkey AS varchar) AS k, CAST(CAST(o_totalprice AS decimal(18,2)) AS double) AS p, CAST(5.5 AS double) AS h FROM orders")
add("fn_fulltext_match", "SELECT p_partkey FROM t_part WHERE to_tsvector('english', p_name) @@ plainto_tsquery('english', 'ring')", "SELECT p_partkey FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), 'ring')")
add("fn_fulltext_rank", "SELECT p_partkey, CAST(ts_rank(to_tsvector('english', p_type), to_tsquery('english', 'small | economy')) AS bigint) AS r FROM t_part", "SELECT p_partkey, CAST(list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9_]+'), 'small') AS bigint) + CAST(list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9_]+'), 'economy') AS bigint) AS r FROM part")
add("fn_to_char_lpad", "SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD') AS d, lpad(CAST(o_custkey AS text), 10, '0') AS c FROM t_order", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, lpad(CAST(o_custkey AS varchar), 10, '0') AS c FROM orders")
add("fn_extract_epoch", "SELECT o_orderkey, EXTRACT(EPOCH FROM o_orderdate) AS s, EXTRACT(YEAR FROM o_orderdate) AS y FROM t_order", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS bigint) AS s, CAST(year(o_orderdate) AS int) AS y FROM orders")
add("fn_arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS a, l_orderkey % 7 AS b, l_quantity / 4 - 1 AS c FROM t_order_item")
add("fn_in_between_null", "SELECT o_orderkey FROM t_order WHERE (o_custkey BETWEEN 10 AND 20 OR o_custkey IN (30, 31)) AND nullif(o_orderstatus, 'F') IS NOT NULL AND NOT (o_orderpriority LIKE '1%')")

# -- dialects --
add("dialect_mysql_limit", "SELECT o_orderkey FROM t_order ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", dialect="mysql")
add("dialect_mysql_backtick", "SELECT `o_orderkey`, `o_custkey` AS `key` FROM `t_order` WHERE `o_custkey` = ?", "SELECT o_orderkey, o_custkey AS key FROM orders WHERE o_custkey = 7", args=(7,), dialect="mysql")
add("dialect_pg_placeholder", 'SELECT "o_orderkey", o_custkey FROM "t_order" WHERE o_custkey = $1 OR o_orderkey = $1', "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey = 7", args=(7,))
add("dialect_pg_limit_params", "SELECT o_orderkey FROM t_order WHERE o_custkey > $3 ORDER BY o_orderkey LIMIT $1 OFFSET $2", args=(7, 3, 100))
add("dialect_mysql_ifnull", "SELECT o_orderkey, IFNULL(NULLIF(o_orderstatus, \"F\"), 'n''a') AS st FROM t_order", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'n''a') AS st FROM orders", dialect="mysql")


# -- writes: each gives the table as it is afterwards --
_STATE = "o_orderkey, o_custkey, o_orderstatus, CAST(cast(o_totalprice AS decimal(18,2)) AS double) AS o_totalprice"


def _after(spark: SparkSession, sf_dir: str, *statements: str, dialect: str = "postgresql", returning: bool = False, key: str = "", kind: str = "snowflake", properties: dict | None = None, state: str = _STATE, of: Any = None) -> DataFrame:
    made = rules()
    if key:
        made["t_order"].key_generator = KeyGenerator(key, kind, properties or {})
    e = Engine(spark, made, dialect)
    e.attach_store("t_order", scratch(spark, "store"), read(spark, sf_dir, "orders"))
    results = [e.execute(s) for s in statements]
    out = results[-1].returning if returning else e.sql(f"SELECT {state} FROM t_order")
    return of(out) if of else out


def write(name: str, oracle: str, *statements: str, **options: Any) -> None:
    _QUERIES[name] = lambda spark, sf_dir: _after(spark, sf_dir, *statements, **options)
    if oracle:
        _ORACLES[name] = oracle


write("dml_insert_values", f"SELECT {_STATE} FROM orders UNION ALL SELECT * FROM (VALUES (CAST(900000000001 AS bigint), CAST(4 AS bigint), 'X', CAST(1.5 AS double)), (900000000004, 7, 'Y', 2.5))", "INSERT INTO t_order (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES (900000000001, 4, 'X', 1.5), (900000000004, 7, 'Y', 2.5)")
@query("dml_insert_generated_key", "SELECT kind, 4 + 2 * (SELECT count(*) FROM orders) AS n, 0 AS repeated FROM (VALUES ('snowflake'), ('snowflake of a worker'), ('increment')) AS t(kind)")
def _generated(spark, sf_dir):
    """Four INSERTs, two of them of a query over all orders: no key comes twice."""
    out = []
    for kind, made in {"snowflake": KeyGenerator("o_orderkey"), "snowflake of a worker": KeyGenerator("o_orderkey", properties={"workerId": 3, "datacenterId": 2}), "increment": KeyGenerator("o_orderkey", "increment", {"start": 100, "step": 5})}.items():
        all_rules = rules()
        all_rules["t_order"].key_generator = made
        e = Engine(spark, all_rules, "postgresql")
        e.attach_store("t_order", scratch(spark, "store"), schema=read(spark, sf_dir, "orders").schema)
        e.register("orders_in", read(spark, sf_dir, "orders"))
        for _ in range(2):
            e.execute("INSERT INTO t_order (o_custkey, o_orderstatus, o_totalprice) VALUES (4, 'X', 1.5), (7, 'Y', 2.5)")
            e.execute("INSERT INTO t_order (o_custkey, o_orderstatus, o_totalprice) SELECT o_custkey, o_orderstatus, o_totalprice FROM orders_in")
        out.append(e.sql("SELECT count(*) AS n, CAST(count(*) - count(DISTINCT o_orderkey) AS int) AS repeated FROM t_order").select(F.lit(kind).alias("kind"), "n", "repeated"))
    return out[0].unionByName(out[1]).unionByName(out[2])


write("dml_increment_keys", "SELECT CAST(105 AS bigint) + 5 * (row_number() OVER (ORDER BY c) - 1) AS o_orderkey, c AS o_custkey FROM (VALUES (CAST(1 AS bigint)), (2), (3), (4)) AS t(c)", "DELETE FROM t_order", "INSERT INTO t_order (o_custkey) VALUES (1), (2)", "INSERT INTO t_order (o_custkey) VALUES (3)", "INSERT INTO t_order (o_custkey) VALUES (4)", key="o_orderkey", kind="increment", properties={"start": 100, "step": 5}, state="o_orderkey, o_custkey")
write("dml_upsert_keeps_literals", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'was excluded.o_orderstatus, not X' ELSE o_orderstatus END AS o_orderstatus FROM orders", "INSERT INTO t_order (o_orderkey, o_custkey, o_orderstatus) SELECT min(o_orderkey), 4, 'X' FROM t_order ON CONFLICT (o_orderkey) DO UPDATE SET o_orderstatus = 'was excluded.o_orderstatus, not ' || EXCLUDED.o_orderstatus", state="o_orderkey, o_orderstatus")
write("dml_update_json_concat", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN '{\"a\":1,\"b\":2}' ELSE o_orderstatus END AS o_orderstatus FROM orders", "UPDATE t_order SET o_orderstatus = '{\"a\":1,\"b\":0}' WHERE o_custkey % 3 = 1", "UPDATE t_order SET o_orderstatus = o_orderstatus || '{\"b\":2}'::jsonb WHERE o_custkey % 3 = 1", state="o_orderkey, o_orderstatus")
write("ddl_alter_add_column", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'seen' END AS note FROM orders", "ALTER TABLE t_order ADD COLUMN note TEXT", "UPDATE t_order SET note = 'seen' WHERE o_custkey = 7", state="o_orderkey, note")
write("ddl_describe", "SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint')) AS t(col_name, data_type)", "DESCRIBE t_order", returning=True, of=lambda df: df.where("col_name IN ('o_orderkey', 'o_custkey')"))


@query("ddl_show_and_drop", "SELECT 't_order' AS shown, 1 AS before, 0 AS after")
def _drop(spark, sf_dir):
    e = engine(spark, sf_dir, only={"t_order"})
    mine = "table = 't_order'"
    before = e.execute("SHOW TABLES").returning.where(mine).count()
    e.execute("DROP TABLE t_order")
    return _rows(spark, [("t_order", before, e.execute("SHOW TABLES").returning.where(mine).count())], "shown string, before int, after int")


write("dml_insert_select", f"SELECT {_STATE} FROM orders UNION ALL SELECT o_orderkey + 900000000000, o_custkey, 'C', CAST(cast(o_totalprice AS decimal(18,2)) AS double) FROM orders WHERE o_custkey = 7", "INSERT INTO t_order SELECT o_orderkey + 900000000000, o_custkey, 'C', o_totalprice, o_orderdate, o_orderpriority FROM t_order WHERE o_custkey = 7")
write("dml_update_cow", f"SELECT {_STATE.replace('o_orderstatus', chr(39) + 'U' + chr(39) + ' AS o_orderstatus')} FROM orders WHERE o_custkey = 7 UNION ALL SELECT {_STATE} FROM orders WHERE o_custkey <> 7", "UPDATE t_order SET o_orderstatus = 'U' WHERE o_custkey = 7")
write("dml_update_subquery", "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice >= (SELECT max(o_totalprice) FROM orders) THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CAST(cast(o_totalprice AS decimal(18,2)) AS double) AS o_totalprice FROM orders", "UPDATE t_order SET o_orderstatus = 'M' WHERE o_totalprice IN (SELECT max(o_totalprice) FROM t_order)")
write("dml_update_moves_rows", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 8 ELSE o_custkey END AS o_custkey, o_orderstatus, CAST(cast(o_totalprice AS decimal(18,2)) AS double) AS o_totalprice FROM orders", "UPDATE t_order SET o_custkey = o_custkey + 1 WHERE o_custkey = 7")
write("dml_delete_cow", f"SELECT {_STATE} FROM orders WHERE o_custkey NOT IN (7, 10)", "DELETE FROM t_order WHERE o_custkey IN (7, 10)")
write("dml_upsert_ignore", f"SELECT {_STATE} FROM orders UNION ALL SELECT CAST(900000000001 AS bigint), CAST(4 AS bigint), 'X', CAST(1.5 AS double)", "INSERT INTO t_order (o_orderkey, o_custkey, o_orderstatus, o_totalprice) SELECT min(o_orderkey), 4, 'X', 1.5 FROM t_order UNION ALL SELECT 900000000001, 4, 'X', 1.5 ON CONFLICT (o_orderkey) DO NOTHING")
write("dml_upsert_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CAST(cast(o_totalprice AS decimal(18,2)) AS double) AS o_totalprice FROM orders", "INSERT INTO t_order (o_orderkey, o_custkey, o_orderstatus, o_totalprice) SELECT min(o_orderkey), 4, 'X', 1.5 FROM t_order ON CONFLICT (o_orderkey) DO UPDATE SET o_orderstatus = EXCLUDED.o_orderstatus")
write("dml_replace_into", f"SELECT {_STATE} FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT min(o_orderkey), CAST(4 AS bigint), 'X', CAST(1.5 AS double) FROM orders", "REPLACE INTO t_order (o_orderkey, o_custkey, o_orderstatus, o_totalprice) SELECT min(o_orderkey), 4, 'X', 1.5 FROM t_order", dialect="mysql")
write("dml_update_returning", "SELECT o_orderkey, 'U' AS o_orderstatus FROM orders WHERE o_custkey = 7", "UPDATE t_order SET o_orderstatus = 'U' WHERE o_custkey = 7 RETURNING o_orderkey, o_orderstatus", returning=True)
write("dml_delete_returning", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7", "DELETE FROM t_order WHERE o_custkey = 7 RETURNING o_orderkey, o_orderstatus", returning=True)
write("dml_insert_returning", "SELECT CAST(900000000001 AS bigint) AS o_orderkey, 'X' AS st", "INSERT INTO t_order (o_orderkey, o_custkey, o_orderstatus) VALUES (900000000001, 4, 'X') RETURNING o_orderkey, o_orderstatus AS st", returning=True)
write("dml_truncate", f"SELECT {_STATE} FROM orders WHERE false", "TRUNCATE TABLE t_order")
write("dml_merge", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 7 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CAST(cast(o_totalprice AS decimal(18,2)) AS double) AS o_totalprice FROM orders WHERE o_custkey <> 10 UNION ALL SELECT o_orderkey + 900000000000, 8, 'N', CAST(0 AS double) FROM orders WHERE o_custkey = 7", "MERGE INTO t_order t USING (SELECT o_orderkey AS k, o_custkey AS c FROM t_order WHERE o_custkey IN (7, 10) UNION ALL SELECT o_orderkey + 900000000000, 8 FROM t_order WHERE o_custkey = 7) s ON t.o_orderkey = s.k WHEN MATCHED AND s.c = 10 THEN DELETE WHEN MATCHED THEN UPDATE SET o_orderstatus = 'M' WHEN NOT MATCHED THEN INSERT (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES (s.k, s.c, 'N', 0)")


@query("view_over_shards", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _view(spark, sf_dir):
    e = engine(spark, sf_dir, only={"t_order"})
    e.execute("CREATE VIEW order_counts AS SELECT o_custkey, count(*) AS n FROM t_order GROUP BY o_custkey")
    return e.sql("SELECT * FROM order_counts WHERE n > 12")


@query("table_function", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def _table_function(spark, sf_dir):
    e = engine(spark, sf_dir, only={"t_order"})
    e.define("get_user_orders", "SELECT o_orderkey, o_orderstatus FROM t_order WHERE o_custkey = $1")
    return e.call("get_user_orders", 7)


@query("txn_two_tables", "SELECT (SELECT count(*) FROM orders WHERE o_custkey <> 7) AS orders_left, (SELECT count(*) FROM customer WHERE c_custkey <> 7) AS users_left")
def _txn(spark, sf_dir):
    e = Engine(spark, rules(), "postgresql")
    for name in ("t_order", "t_user"):
        e.attach_store(name, scratch(spark, "store"), read(spark, sf_dir, BASE[name]))
    with e.transaction() as tx:
        tx.execute("DELETE FROM t_order WHERE o_custkey = 7")
        tx.execute("DELETE FROM t_user WHERE c_custkey = 7")
    return e.sql("SELECT (SELECT count(*) FROM t_order) AS orders_left, (SELECT count(*) FROM t_user) AS users_left")


@query("txn_own_writes", "SELECT (SELECT count(*) FROM orders WHERE o_custkey <> 7 AND o_custkey <> 10) AS seen, (SELECT count(*) FROM orders) AS others_saw, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (7, 10)) AS after, (SELECT count(*) FROM orders WHERE o_custkey = 8) AS updated")
def _txn_own(spark, sf_dir):
    e = Engine(spark, rules(), "postgresql")
    e.attach_store("t_order", scratch(spark, "store"), read(spark, sf_dir, "orders"))
    total = "SELECT count(*) AS n FROM t_order"
    with e.transaction() as tx:
        tx.execute("DELETE FROM t_order WHERE o_custkey = 7")
        tx.execute("UPDATE t_order SET o_orderstatus = 'T' WHERE o_custkey IN (8, 10)")
        tx.execute("DELETE FROM t_order WHERE o_custkey = 10 AND o_orderstatus = 'T'")
        seen, others = tx.sql(total).first()[0], e.sql(total).first()[0]
    return e.sql(f"SELECT CAST({seen} AS bigint) AS seen, CAST({others} AS bigint) AS others_saw, count(*) AS after, count(CASE WHEN o_orderstatus = 'T' THEN 1 END) AS updated FROM t_order")


# -- tools, as small DataFrames --
_SAMPLES = {
    "point": "SELECT o_orderkey FROM t_order WHERE o_custkey = 7",
    "join": "SELECT * FROM users u JOIN posts p ON u.id = p.user_id ORDER BY u.id",
    "cte": "WITH s AS (SELECT user_id, COUNT(*) AS c FROM posts GROUP BY user_id) SELECT u.name, ROW_NUMBER() OVER (ORDER BY s.c) FROM users u LEFT JOIN s ON u.id = s.user_id",
    "insert": "INSERT INTO users VALUES (1, 'a')",
}


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("tool_complexity", "SELECT * FROM (VALUES ('point', 2), ('join', 9), ('cte', 23), ('insert', 27)) AS t(name, score)")
def _complexity(spark, sf_dir):
    return _rows(spark, [(k, analysis.analyze(v).score) for k, v in _SAMPLES.items()], "name string, score int")


@query("tool_suggestions")
def _suggestions(spark, sf_dir):
    return _rows(spark, [(k, *s) for k, v in _SAMPLES.items() for s in analysis.suggestions(v)], "name string, type string, severity string, advice string")


@query("tool_dependencies", "SELECT * FROM (VALUES ('join', 'users', 'posts'), ('cte', 'users', 's')) AS t(name, l, r)")
def _dependencies(spark, sf_dir):
    return _rows(spark, [(k, a, b) for k, v in _SAMPLES.items() for a, bs in analysis.analyze(v).dependencies.items() for b in bs], "name string, l string, r string")


@query("tool_plan_steps")
def _plan_steps(spark, sf_dir):
    return _rows(spark, [(k, i, s.kind, s.operation, s.cost) for k, v in _SAMPLES.items() for i, s in enumerate(planning.plan(v, {"t_order"}).steps)], "name string, at int, kind string, operation string, cost double")


@query("tool_cost", "SELECT * FROM (VALUES ('point', CAST(0.5 AS double)), ('join', 16), ('cte', 16), ('insert', 1)) AS t(name, cost)")
def _cost(spark, sf_dir):
    return _rows(spark, [(k, planning.estimate(v, {"t_order": 1000, "users": 1000, "posts": 5000})) for k, v in _SAMPLES.items()], "name string, cost double")


@query("tool_snowflake_fields", "SELECT count(*) AS n, count(*) AS distinct_ids, CAST(1700000000000 AS bigint) AS first_ms FROM orders")
def _snowflake(spark, sf_dir):
    made = keys.with_snowflake(read(spark, sf_dir, "orders").select("o_orderkey"), "id", 1_700_000_000_000)
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), (F.shiftright(F.min("id"), 22) + keys.EPOCH_MS).alias("first_ms"))


@query("tool_increment_keys", "SELECT count(*) AS n, CAST(105 AS bigint) AS lo, CAST(100 + 5 * count(*) AS bigint) AS hi FROM orders")
def _increment(spark, sf_dir):
    return keys.with_increment(read(spark, sf_dir, "orders"), "id", 100, 5).agg(F.count_distinct("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("tool_read_write_route", "SELECT * FROM (VALUES (0, 'r0'), (1, 'r1'), (2, 'w'), (3, 'r0')) AS t(place, source)")
def _rw(spark, sf_dir):
    s = Splitter(ReadWriteSplit("rw", "w", ["r0", "r1"]))
    return _rows(spark, [(i, s.route(q)) for i, q in enumerate(("SELECT 1", "SELECT 2", "UPDATE t SET a = 1", "SELECT 3"))], "place int, source string")


@query("tool_metrics")
def _metrics(spark, sf_dir):
    e = engine(spark, sf_dir, only={"t_order"})
    e.sql("SELECT count(*) FROM t_order").collect()
    return _rows(spark, [(x,) for x in e.metrics.collector.text().splitlines()], "line string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
