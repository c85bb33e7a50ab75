"""Relational queries: projections, predicates, joins, aggregates, windows, order, sets and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import load
from .registry import query, sql

EMP = """(VALUES (1,'Oda',10,7100.0,CAST(NULL AS INT)),(2,'Per',10,5200.0,1),(3,'Quin',20,6400.0,1),(4,'Rui',20,6400.0,3),(5,'Sol',30,4800.0,1),(6,'Tova',30,4100.0,5),
 (7,'Uma',30,3900.0,6),(8,'Vic',40,8200.0,CAST(NULL AS INT)),(9,'Wen',40,3300.0,8)) AS emp(emp_id, emp_name, dept_id, salary, manager_id)"""
KEYS = "(VALUES (1,'north',7),(2,'south',CAST(NULL AS INT)),(3,'east',7),(4,'west',CAST(NULL AS INT)),(5,'centre',9),(6,'coast',8)) AS k(id, name, group_id)"
REFS = "(VALUES (7,'red'),(9,'blue'),(11,'grey')) AS r(gid, label)"
NUMS = "(VALUES (1, CAST(NULL AS INT)),(2, 5),(3, 1),(4, CAST(NULL AS INT)),(5, 3)) AS n(id, val)"

# ---- sources
sql("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
sql("scan_columns_limit", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25")
sql("scan_filters_and", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_discount <= 0.02")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a', 1.5), (2, 'b', 2.5), (3, NULL, NULL)) AS t(id, name, score)", "SELECT id, name, CAST(score AS DECIMAL(2,1)) AS score FROM (VALUES (1, 'a', 1.5), (2, 'b', 2.5), (3, NULL, NULL)) AS t(id, name, score)")
sql("select_without_from", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, CAST(NULL AS STRING) AS nothing", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, CAST(NULL AS VARCHAR) AS nothing")

# ---- projections and predicates
sql("proj_alias", "SELECT n_name AS nation_name, n_regionkey AS region_key FROM nation")
sql("proj_star", "SELECT * FROM region")
sql("proj_arith", "SELECT p_partkey, p_size + 1 AS plus, p_size - 1 AS minus, p_size * 2 AS times, -p_size AS neg, p_size % 7 AS modulo, p_size div 7 AS quotient FROM part", "SELECT p_partkey, p_size + 1 AS plus, p_size - 1 AS minus, p_size * 2 AS times, -p_size AS neg, p_size % 7 AS modulo, CAST(p_size // 7 AS BIGINT) AS quotient FROM part")
sql("proj_double_arith", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
sql("proj_bitwise", "SELECT p_partkey, p_size & 7 AS a, p_size | 8 AS o, p_size ^ 5 AS x FROM part", "SELECT p_partkey, p_size & 7 AS a, p_size | 8 AS o, xor(p_size, 5) AS x FROM part")
sql("proj_concat", "SELECT s_suppkey, s_name || '-' || CAST(s_nationkey AS STRING) AS tag FROM supplier", "SELECT s_suppkey, s_name || '-' || CAST(s_nationkey AS VARCHAR) AS tag FROM supplier")
sql("filter_cmp", "SELECT p_partkey FROM part WHERE p_size >= 40 AND p_size <> 45 AND p_retailprice < 1500")
sql("filter_logic", "SELECT s_suppkey FROM supplier WHERE (s_acctbal < 0 OR s_nationkey = 3) AND NOT (s_nationkey = 5)")
sql("filter_three_valued", f"SELECT id, val > 2 AS big, (val > 2) OR (id = 1) AS either, NOT (val > 2) AS negated FROM {NUMS}")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%ring' OR p_name LIKE '_ed%'")
sql("filter_not_like_escape", "SELECT v FROM (VALUES ('a_b'), ('axb'), ('10%'), ('100')) AS t(v) WHERE v LIKE '%!_%' ESCAPE '!' OR v LIKE '10!%' ESCAPE '!'")
sql("filter_ilike", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
sql("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F', 'P')")
sql("filter_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000 AND o_custkey NOT BETWEEN 100 AND 1000")
sql("filter_null", f"SELECT id, val IS NULL AS is_null, val IS NOT NULL AS not_null FROM {NUMS} WHERE val IS NULL OR val > 1")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'partial' END AS status FROM orders")
sql("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
sql("cast_types", "SELECT CAST('42' AS INT) AS i, CAST(3.99 AS BIGINT) AS b, CAST(7 AS DOUBLE) AS d, CAST('2024-02-29' AS DATE) AS dt, CAST(1 AS BOOLEAN) AS yes, CAST(12.345 AS DECIMAL(10,2)) AS dec, CAST(99 AS STRING) AS s", "SELECT CAST('42' AS INT) AS i, CAST(3 AS BIGINT) AS b, CAST(7 AS DOUBLE) AS d, CAST('2024-02-29' AS DATE) AS dt, CAST(1 AS BOOLEAN) AS yes, CAST(12.35 AS DECIMAL(10,2)) AS dec, CAST(99 AS VARCHAR) AS s")
sql("cast_lenient", "SELECT v, try_cast(v AS INT) AS i FROM (VALUES ('1'), ('x'), ('3')) AS t(v)")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("coalesce_nullif", f"SELECT id, coalesce(val, -1) AS filled, nullif(val, 5) AS emptied FROM {NUMS}")

# ---- subqueries
sql("subq_scalar", "SELECT p_partkey, p_retailprice - (SELECT avg(p_retailprice) FROM part) > 0 AS above FROM part")
sql("subq_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql("subq_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
sql("subq_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("subq_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("subq_correlated_select", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
sql("subq_correlated_where", "SELECT p.p_partkey FROM part p WHERE p.p_retailprice > (SELECT 1.2 * avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
sql("derived_table", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10")
sql("cte_single", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 350000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
sql("cte_multi", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS orders_n FROM a JOIN b ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql("cte_chain", "WITH a AS (SELECT l_suppkey, l_quantity FROM lineitem), b AS (SELECT l_suppkey, sum(l_quantity) AS q FROM a GROUP BY l_suppkey), c AS (SELECT * FROM b WHERE q > 1000) SELECT count(*) AS n FROM c")
sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS square FROM t")
sql("subq_nested", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN (SELECT min(r_name) FROM region)))")

# ---- joins
sql("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey")
sql("join_residual", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 45")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
sql("join_left_unmatched", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NULL")
sql("join_right", f"SELECT k.id, r.gid, r.label FROM {KEYS} RIGHT JOIN {REFS} ON k.group_id = r.gid")
sql("join_full", f"SELECT k.id, r.gid FROM {KEYS} FULL OUTER JOIN {REFS} ON k.group_id = r.gid")
sql("join_cross", "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2")
sql("join_comma", "SELECT s_name, n_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'")
sql("join_self", f"SELECT e.emp_name, m.emp_name AS manager FROM {EMP} LEFT JOIN {EMP.replace('AS emp(', 'AS m(')} ON emp.manager_id = m.emp_id".replace("e.emp_name", "emp.emp_name"))
sql("join_multiway", "SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE r_name = 'AFRICA'")
sql("join_theta", "SELECT a.s_suppkey AS poor, b.s_suppkey AS rich FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
sql("join_semi", "SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49", "SELECT p_partkey FROM part SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49")
sql("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48", "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48")
sql("join_not_in", f"SELECT r.gid FROM {REFS} WHERE r.gid NOT IN (SELECT k.group_id FROM {KEYS} WHERE k.group_id IS NOT NULL)")
sql("join_not_in_null_empty", f"SELECT r.gid FROM {REFS} WHERE r.gid NOT IN (SELECT k.group_id FROM {KEYS})")
sql("join_null_keys", f"SELECT a.id AS left_id, b.id AS right_id FROM {KEYS.replace('AS k(', 'AS a(')} JOIN {KEYS.replace('AS k(', 'AS b(')} ON a.group_id = b.group_id")
sql("join_null_safe", f"SELECT a.id AS left_id, b.id AS right_id FROM {KEYS.replace('AS k(', 'AS a(')} JOIN {KEYS.replace('AS k(', 'AS b(')} ON a.group_id <=> b.group_id", f"SELECT a.id AS left_id, b.id AS right_id FROM {KEYS.replace('AS k(', 'AS a(')} JOIN {KEYS.replace('AS k(', 'AS b(')} ON a.group_id IS NOT DISTINCT FROM b.group_id")
sql("join_using", f"SELECT gid, label, n FROM {REFS} JOIN (VALUES (7, 1), (11, 2)) AS x(gid, n) USING (gid)")
sql("join_lateral_unnest", "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 4)) e AS pos, x", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 5) r(i)")
sql("join_hint_broadcast", "SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")

# ---- aggregates
sql("agg_count", f"SELECT count(*) AS n, count(val) AS filled FROM {NUMS}")
sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
sql("agg_sum_avg", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, CAST(sum(o_custkey) AS BIGINT) AS ids FROM orders GROUP BY o_orderstatus")
sql("agg_min_max", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS first_p, max(o_orderdate) AS last_d FROM orders")
sql("agg_group_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderstatus")
sql("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600 AND avg(l_quantity) > 25")
sql("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS m FROM orders WHERE o_totalprice < 0")
sql("agg_over_join", "SELECT r_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING sum(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)")
sql("agg_conditional", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderstatus")
sql("agg_group_concat", f"SELECT dept_id, listagg(emp_name, ',') WITHIN GROUP (ORDER BY emp_id) AS names FROM {EMP} GROUP BY dept_id", f"SELECT dept_id, string_agg(emp_name, ',' ORDER BY emp_id) AS names FROM {EMP} GROUP BY dept_id")
sql("agg_group_concat_distinct", "SELECT l_returnflag, listagg(DISTINCT l_linestatus, '|') WITHIN GROUP (ORDER BY l_linestatus) AS states FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS states FROM lineitem GROUP BY l_returnflag")
sql("agg_group_concat_empty", f"SELECT listagg(emp_name, ',') WITHIN GROUP (ORDER BY emp_id) AS names FROM {EMP} WHERE emp_id < 0", "SELECT CAST(NULL AS VARCHAR) AS names")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("agg_stddev", "SELECT round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, median(l_quantity) AS med FROM lineitem")
sql("agg_bool_bit", "SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS every_one, bool_or(c_acctbal > 9990) AS any_one, bit_or(c_nationkey) AS bits FROM customer GROUP BY c_mktsegment")
sql("agg_array", f"SELECT dept_id, sort_array(collect_list(emp_name)) AS names FROM {EMP} GROUP BY dept_id", f"SELECT dept_id, list_sort(array_agg(emp_name)) AS names FROM {EMP} GROUP BY dept_id")
# What approximate aggregates say is held against the other engine's exact rows: a group is told with its exact count if the guess is near that.
sql("agg_approx_distinct_close", "SELECT l_returnflag, CASE WHEN abs(approx_count_distinct(l_orderkey, 0.02) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) THEN count(DISTINCT l_orderkey) END AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_approx_percentile_close", "SELECT l_returnflag, percentile_approx(l_quantity, array(0.25, 0.5, 0.9), 100000) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, [0.25, 0.5, 0.9]) AS q FROM lineitem GROUP BY l_returnflag")


@query("agg_bitmap_count", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_bitmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct count of integers by bitmaps per bucket: the sets merge by union, with no cap on their number."""
    e = load(spark, sf_dir, "events")
    maps = e.groupBy("event_type", F.bitmap_bucket_number("user_id").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("m"))
    return maps.groupBy("event_type").agg(F.sum(F.bitmap_count("m")).alias("users"))


# ---- windows
O3 = "FROM orders"
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER ({W}) AS BIGINT) AS rn {O3}")
sql("win_row_number_global", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rn FROM supplier")
sql("win_rank_dense", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({W}) AS before, lead(o_totalprice, 2) OVER ({W}) AS after2, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER ({W}) AS with_default {O3}")
sql("win_running", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({W}), 2) AS s, avg(o_orderkey) OVER ({W}) AS a, count(*) OVER ({W}) AS n, min(o_totalprice) OVER ({W}) AS lo, max(o_totalprice) OVER ({W}) AS hi {O3}")
sql("win_range_peers", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS up_to_peers FROM part")
sql("win_partition_total", "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS total FROM supplier")
sql("win_global", "SELECT r_regionkey, count(*) OVER () AS n, CAST(sum(r_regionkey) OVER () AS BIGINT) AS s FROM region")
for name, frame in {"moving": "1 PRECEDING AND 1 FOLLOWING", "remaining": "CURRENT ROW AND UNBOUNDED FOLLOWING", "preceding": "2 PRECEDING AND CURRENT ROW", "whole": "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "one_before": "1 PRECEDING AND 1 PRECEDING", "cumulative": "UNBOUNDED PRECEDING AND CURRENT ROW", "ahead": "1 FOLLOWING AND 3 FOLLOWING"}.items():
    sql(f"win_rows_{name}", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({W} ROWS BETWEEN {frame}), 2) AS s, count(*) OVER ({W} ROWS BETWEEN {frame}) AS n {O3}")
sql("win_range_value", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
sql("win_over_agg", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s, CAST(row_number() OVER (ORDER BY sum(o_totalprice) DESC) AS BIGINT) AS rn FROM orders GROUP BY o_orderpriority")
sql("win_topn", "SELECT * FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rn FROM part) t WHERE rn <= 3")
sql("win_qualify", "SELECT n_regionkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) t WHERE rn = 1", "SELECT n_regionkey, n_name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) = 1")
sql("win_pct_of_total", "SELECT n_name, round(100.0 * s / sum(s) OVER (), 6) AS pct FROM (SELECT n_name, sum(s_acctbal) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) t")
sql("win_nulls", f"SELECT id, CAST(row_number() OVER (ORDER BY val ASC NULLS LAST, id) AS BIGINT) AS last_, CAST(rank() OVER (ORDER BY val DESC NULLS FIRST) AS BIGINT) AS first_, count(*) OVER (PARTITION BY val) AS same FROM {NUMS}")
sql("win_ntile_dist", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS q, round(percent_rank() OVER (ORDER BY s_acctbal), 8) AS pr, round(cume_dist() OVER (ORDER BY s_acctbal), 8) AS cd FROM supplier")
sql("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({W}) AS f, last_value(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 {O3}")

# ---- order, limits, sets
sql("sort_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC, p_size DESC, p_partkey LIMIT 50")
sql("sort_nulls", f"SELECT id, val FROM {NUMS} ORDER BY val ASC NULLS LAST, id LIMIT 4")
sql("sort_expr_alias", "SELECT s_suppkey, abs(s_acctbal) AS size FROM supplier ORDER BY size DESC, 1 LIMIT 10")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("limit_zero_empty", "SELECT o_orderkey FROM orders LIMIT 0")
sql("offset_past_end_empty", "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 5 OFFSET 50")
sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
sql("sort_distribute", "SELECT n_regionkey, n_name FROM nation DISTRIBUTE BY n_regionkey SORT BY n_name", "SELECT n_regionkey, n_name FROM nation")
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
sql("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier")
sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("set_intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey % 5 FROM supplier WHERE s_suppkey < 12")
sql("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
sql("set_parenthesised", "(SELECT r_regionkey AS k FROM region) UNION ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")


@query("df_star_join", "SELECT r_name, c_mktsegment, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment")
def df_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operators by the DataFrame API. Dimensions are broadcast where Spark sees that they are small."""
    o, c, n, r = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("df_latest_by_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
def df_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as a maximum, which combines before the shuffle, where a window would move and sort all rows."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("df_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS f, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o FROM lineitem GROUP BY l_returnflag")
def df_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity")
    return out.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("df_salted_agg", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def df_salted_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distinct count over few hot keys in two steps: by (key, value) first, so that no key's rows meet in one task."""
    e = load(spark, sf_dir, "events")
    per_user = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return per_user.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.count("user_id").alias("users"))


@query("df_asof_join", "SELECT event_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM (SELECT e.event_id, o.o_orderkey, o.o_orderdate FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts) t GROUP BY event_id")
def df_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a user at the time of each event: one union sorted by key and time, and the last order carried forward."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("long").alias("o"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("t", F.col("o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionAll(o).withColumn("last", F.last("o", ignorenulls=True).over(w)).filter("event_id is not null").select("event_id", F.col("last").alias("o_orderkey"))
