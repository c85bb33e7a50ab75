"""The 22 decision-support queries on the tables at hand.

These lack some columns and a table (part by supplier), so some queries keep their shape on other columns: line items
stand for the missing table, ship dates for commit and receipt dates. All texts are plain enough for both engines.
"""

from __future__ import annotations

from .registry import sql

REVENUE = "l_extendedprice * (1 - l_discount)"

sql("tpch_q1", f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({REVENUE}), 2) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")

sql("tpch_q2", """
WITH cost AS (
  SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS unit_cost FROM lineitem GROUP BY l_partkey, l_suppkey
), local AS (
  SELECT c.l_partkey, c.l_suppkey, c.unit_cost, s.s_name, s.s_acctbal, n.n_name FROM cost c JOIN supplier s ON s.s_suppkey = c.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'EUROPE'
)
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
FROM (SELECT local.*, p_partkey, p_brand, min(unit_cost) OVER (PARTITION BY l_partkey) AS least FROM part JOIN local ON l_partkey = p_partkey WHERE p_size <= 15 AND p_type = 'ECONOMY') t
WHERE unit_cost = least
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")

sql("tpch_q3", f"""
SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")

sql("tpch_q4", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority""")

sql("tpch_q5", f"""
SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM customer
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name""")

sql("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")

sql("tpch_q7", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
) shipping GROUP BY supp_nation, cust_nation, l_year""")

sql("tpch_q8", f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type IN ('ECONOMY', 'STANDARD')
) all_nations GROUP BY o_year""")

sql("tpch_q9", f"""
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, {REVENUE} - 0.5 * p_retailprice * l_quantity / 50 AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
  WHERE p_name LIKE '%ring%'
) profit GROUP BY nation, o_year""")

sql("tpch_q10", f"""
SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")

sql("tpch_q11", """
WITH held AS (
  SELECT l_partkey, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE n_name = 'NATION_7' GROUP BY l_partkey
)
SELECT l_partkey, round(value, 2) AS value FROM held WHERE value > (SELECT sum(value) * 0.002 FROM held)""")

sql("tpch_q12", """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_linestatus""")

sql("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey
) c_orders GROUP BY c_count""")

sql("tpch_q14", f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'""")

sql("tpch_q15", f"""
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey
)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")

sql("tpch_q16", """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 4, 9, 14, 19, 23, 36, 45)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size""")

sql("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""")

sql("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")

sql("tpch_q19", f"""
SELECT round(sum({REVENUE}), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)""")

sql("tpch_q20", """
SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_regionkey = 1 AND s_suppkey IN (
  SELECT l.l_suppkey FROM lineitem l WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
    AND l.l_quantity > (SELECT 1.5 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)
)""")

sql("tpch_q21", """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND n_name = 'NATION_4'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")

sql("tpch_q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (3, 7, 11, 13, 17, 18, 23) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
GROUP BY c_nationkey""")
