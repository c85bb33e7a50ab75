"""Queries that use the engine, its tables, other stores' surfaces, statistics, dialects and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as doc
from ..operators import kv
from ..operators import stores
from ..sources.files import scratch
from ..streaming import events as ev
from ..tables import load, run
from .dialects import DIALECTS
from .engine import Engine
from .registry import query
from .stats import Histogram, column_stats


def engine(spark: SparkSession, sf_dir: str, table: str, columns: str, where: str = "true", key: str = "", dialect: str = "doris") -> Engine:
    """An engine with the table ``t``, a copy of columns of another."""
    e = Engine(spark, scratch(spark), dialect)
    df = load(spark, sf_dir, table).filter(where).selectExpr(*columns.split(", "))
    e.lake.create("t", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), **({"model": "primary", "keys": [key]} if key else {}))
    e.lake.insert("t", df)
    return e


def dml(name: str, table: str, columns: str, statements: list[str], oracle: str, key: str = "", result: str = "SELECT * FROM t", only: str = "*") -> None:
    @query(name, oracle)
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, table, columns, key=key)
        for s in statements:
            e.sql(s)
        return e.sql(result).select(*only.split(", "))


C, CC = "c_custkey, c_name, c_nationkey, c_acctbal", "c_custkey, c_name, c_nationkey, c_acctbal"
dml("dml_insert_values", "region", "r_regionkey, r_name", ["INSERT INTO t VALUES (10, 'NEW'), (5 + 6, upper('expr'))", "INSERT INTO t (r_name) VALUES ('partial')"], "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (10, 'NEW'), (11, 'EXPR'), (NULL, 'partial')) v")
dml("dml_insert_select", "nation", "n_nationkey, n_name", ["INSERT INTO t SELECT DISTINCT n_nationkey + 100, lower(n_name) FROM t WHERE n_nationkey < 3"], "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation WHERE n_nationkey < 3")
dml("dml_insert_set", "region", "r_regionkey, r_name", ["INSERT INTO t SET r_name = 'SET', r_regionkey = 77"], "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'SET'")
dml("dml_insert_overwrite", "region", "r_regionkey, r_name", ["INSERT OVERWRITE TABLE t SELECT r_regionkey * 2, r_name FROM t WHERE r_regionkey > 1"], "SELECT r_regionkey * 2 AS r_regionkey, r_name FROM region WHERE r_regionkey > 1")
dml("dml_update", "customer", C, ["UPDATE t SET c_acctbal = c_acctbal + 100, c_name = concat(c_name, '!') WHERE c_nationkey = 3"], f"SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
dml("dml_update_sequential", "nation", "n_nationkey, n_regionkey", ["UPDATE t SET n_nationkey = n_nationkey + 1000, n_regionkey = n_nationkey WHERE n_regionkey = 2"], "SELECT CASE WHEN n_regionkey = 2 THEN n_nationkey + 1000 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey = 2 THEN n_nationkey + 1000 ELSE n_regionkey END AS n_regionkey FROM nation")
dml("dml_update_subquery", "supplier", "s_suppkey, s_acctbal", ["UPDATE t SET s_acctbal = 0 WHERE s_acctbal > (SELECT avg(s_acctbal) FROM t)"], "SELECT s_suppkey, CASE WHEN s_acctbal > (SELECT avg(s_acctbal) FROM supplier) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
dml("dml_delete", "customer", C, ["DELETE FROM t WHERE c_acctbal < 0 OR c_nationkey IN (1, 2)"], f"SELECT {CC} FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (1, 2))")
dml("dml_delete_limit", "customer", C, ["DELETE FROM t WHERE c_nationkey = 4 ORDER BY c_acctbal DESC, c_custkey LIMIT 5"], f"SELECT {CC} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4 ORDER BY c_acctbal DESC, c_custkey LIMIT 5)")
dml("dml_upsert", "supplier", "s_suppkey, s_name, s_acctbal", ["INSERT INTO t SELECT s_suppkey + 50, 'new', 1.0 FROM t ON DUPLICATE KEY UPDATE s_acctbal = s_acctbal + VALUES(s_acctbal)"], "SELECT s_suppkey, s_name, CASE WHEN s_suppkey - 50 IN (SELECT s_suppkey FROM supplier) THEN s_acctbal + 1.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 50, 'new', 1.0 FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)", key="s_suppkey")
dml("dml_replace", "region", "r_regionkey, r_name", ["REPLACE INTO t VALUES (1, 'one'), (9, 'nine')"], "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'nine'", key="r_regionkey")
dml("dml_merge", "nation", "n_nationkey, n_name", ["CREATE TABLE s AS SELECT n_nationkey + 20 AS n_nationkey, 'merged' AS n_name FROM t WHERE n_nationkey < 10", "MERGE INTO t USING s ON t.n_nationkey = s.n_nationkey WHEN MATCHED THEN UPDATE SET n_name = s.n_name WHEN NOT MATCHED THEN INSERT *"], "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 20 AND 29 THEN 'merged' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'merged' FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
dml("dml_truncate_empty", "region", "r_regionkey, r_name", ["TRUNCATE TABLE t"], "SELECT r_regionkey, r_name FROM region WHERE false")
dml("dml_rollback", "region", "r_regionkey, r_name", ["BEGIN", "DELETE FROM t WHERE r_regionkey > 0", "ROLLBACK", "BEGIN", "UPDATE t SET r_name = 'x' WHERE r_regionkey = 0", "COMMIT"], "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'x' ELSE r_name END AS r_name FROM region")
dml("ddl_alter", "nation", "n_nationkey, n_name, n_regionkey", ["ALTER TABLE t ADD COLUMN size INT DEFAULT 7", "ALTER TABLE t ADD COLUMN note VARCHAR(20)", "ALTER TABLE t RENAME COLUMN n_name TO name", "ALTER TABLE t DROP COLUMN n_regionkey", "ALTER TABLE t MODIFY COLUMN n_nationkey BIGINT", "ALTER TABLE t RENAME TO u"], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, 7 AS size, CAST(NULL AS VARCHAR) AS note FROM nation", result="SELECT * FROM u")
dml("ddl_ctas_view", "orders", "o_orderkey, o_orderstatus, o_totalprice", ["CREATE TABLE a AS SELECT o_orderstatus, count(*) AS n FROM t GROUP BY o_orderstatus", "CREATE VIEW v AS SELECT o_orderstatus, n * 2 AS n2 FROM a"], "SELECT o_orderstatus, count(*) * 2 AS n2 FROM orders GROUP BY o_orderstatus", result="SELECT * FROM v")
dml("ddl_swap", "region", "r_regionkey, r_name", ["CREATE TABLE b AS SELECT r_regionkey, lower(r_name) AS r_name FROM t", "ALTER TABLE t REPLACE WITH TABLE b"], "SELECT r_regionkey, lower(r_name) AS r_name FROM region")
dml("ddl_unique_key", "orders", "o_orderkey, o_custkey", ["CREATE TABLE q (k BIGINT, v BIGINT) UNIQUE KEY(k) DISTRIBUTED BY HASH(k) BUCKETS 4", "INSERT INTO q SELECT o_custkey, 1 FROM t", "INSERT INTO q SELECT o_custkey, 2 FROM t WHERE o_custkey < 100"], "SELECT DISTINCT o_custkey AS k, CAST(CASE WHEN o_custkey < 100 THEN 2 ELSE 1 END AS BIGINT) AS v FROM orders", result="SELECT * FROM q")
dml("ddl_aggregate_key", "orders", "o_custkey, o_orderkey", ["CREATE TABLE q (k BIGINT, n BIGINT SUM, top BIGINT MAX) AGGREGATE KEY(k) DISTRIBUTED BY HASH(k) BUCKETS 4", "INSERT INTO q SELECT o_custkey, 1, o_orderkey FROM t"], "SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY o_custkey", result="SELECT * FROM q")
dml("show_tables", "region", "r_regionkey", ["CREATE TABLE other AS SELECT 1 AS x"], "SELECT * FROM (VALUES ('other'), ('t')) v(name)", result="SHOW TABLES")
dml("describe_table", "nation", "n_nationkey, n_name", [], "SELECT * FROM (VALUES ('n_nationkey', 'int', true), ('n_name', 'string', true)) v(field, type, nullable)", result="DESCRIBE t")
dml("create_function", "nation", "n_nationkey", ["CREATE FUNCTION plus_one(x INT) RETURNS INT RETURN x + 1"], "SELECT n_nationkey + 1 AS y FROM nation", result="SELECT plus_one(n_nationkey) AS y FROM t")
dml("ddl_unique_last_write", "orders", "o_orderkey, o_custkey", ["CREATE TABLE q (k BIGINT, v BIGINT) UNIQUE KEY(k)", *[f"INSERT INTO q SELECT o_custkey, {v} FROM t WHERE o_custkey % {m} = 0" for v, m in ((1, 1), (2, 2), (3, 3), (4, 2), (5, 5))]], "SELECT DISTINCT o_custkey AS k, CAST(CASE WHEN o_custkey % 5 = 0 THEN 5 WHEN o_custkey % 2 = 0 THEN 4 WHEN o_custkey % 3 = 0 THEN 3 ELSE 1 END AS BIGINT) AS v FROM orders", result="SELECT * FROM q")
dml("ddl_aggregate_replace", "orders", "o_custkey, o_orderkey", ["CREATE TABLE q (k BIGINT, n BIGINT SUM, v BIGINT REPLACE) AGGREGATE KEY(k)", *[f"INSERT INTO q SELECT o_custkey, 1, {v} FROM t WHERE o_custkey % {m} = 0" for v, m in ((7, 1), (8, 2), (9, 3))]], "SELECT o_custkey AS k, CAST(count(*) * (1 + CAST(o_custkey % 2 = 0 AS INT) + CAST(o_custkey % 3 = 0 AS INT)) AS BIGINT) AS n, CAST(CASE WHEN o_custkey % 3 = 0 THEN 9 WHEN o_custkey % 2 = 0 THEN 8 ELSE 7 END AS BIGINT) AS v FROM orders GROUP BY o_custkey", result="SELECT * FROM q")
dml("dml_words_in_literals", "nation", "n_nationkey, n_name", ["UPDATE t SET n_name = 'go where it is, set (x' WHERE n_name = 'NATION_3'", "INSERT INTO t VALUES (90, 'on duplicate key update n_name = 1'), (91, 'it''s -- no comment, (select')", "DELETE FROM t WHERE n_name = 'a limit 3' OR n_name = 'NATION_4' ORDER BY n_name LIMIT 5"], "SELECT n_nationkey, CASE WHEN n_name = 'NATION_3' THEN 'go where it is, set (x' ELSE n_name END AS n_name FROM nation WHERE n_name <> 'NATION_4' UNION ALL SELECT * FROM (VALUES (90, 'on duplicate key update n_name = 1'), (91, 'it''s -- no comment, (select')) v")
dml("dml_savepoint", "region", "r_regionkey, r_name", ["BEGIN", "UPDATE t SET r_name = 'one' WHERE r_regionkey = 1", "SAVEPOINT a", "DELETE FROM t WHERE r_regionkey > 1", "ROLLBACK TO SAVEPOINT a", "UPDATE t SET r_name = 'two' WHERE r_regionkey = 2", "COMMIT"], "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE r_name END AS r_name FROM region")
dml("show_partitions", "orders", "o_orderkey, o_orderdate", ["ALTER TABLE t ADD PARTITION p1 VALUES LESS THAN ('1996-01-01')", "ALTER TABLE t ADD PARTITION p2 VALUES LESS THAN ('1997-01-01')", "ALTER TABLE t ADD PARTITION p3 VALUES LESS THAN ('1998-01-01')", "ALTER TABLE t DROP PARTITION p2"], "SELECT * FROM (VALUES ('p1', CAST(NULL AS VARCHAR), '1996-01-01'), ('p3', NULL, '1998-01-01')) v(name, low, high)", result="SHOW PARTITIONS FROM t")
dml("show_index", "nation", "n_nationkey, n_name", [], "SELECT 't' AS table_name, 'PRIMARY' AS key_name, 1 AS seq_in_index, 'n_nationkey' AS column_name", key="n_nationkey", result="SHOW INDEX FROM t")
dml("show_status", "region", "r_regionkey", ["CREATE TABLE other AS SELECT 1 AS x", "CREATE VIEW v AS SELECT x FROM other"], "SELECT * FROM (VALUES ('Tables', '2')) v(name, value)", result="SHOW STATUS LIKE 'tab%'")
dml("analyze_kept", "customer", "c_custkey, c_mktsegment", ["ANALYZE TABLE t WITH SYNC"], "SELECT 'c_custkey' AS \"column\", count(*) AS n, min(c_custkey)::VARCHAR AS low FROM customer UNION ALL SELECT 'c_mktsegment', count(*), min(c_mktsegment) FROM customer", result="SHOW COLUMN STATS t", only="column, n, low")
dml("alter_database", "region", "r_regionkey", ["CREATE DATABASE a", "CREATE TABLE a.x AS SELECT r_regionkey FROM t", "ALTER DATABASE a RENAME TO b", "USE b"], "SELECT r_regionkey FROM region", result="SELECT * FROM x")


@query("explain_rows", "SELECT true AS scans, true AS filters, true AS prunes")
def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether EXPLAIN shows a scan of the table's one column, with the filter pushed down."""
    plan = engine(spark, sf_dir, "region", "r_regionkey, r_name").sql("EXPLAIN FORMATTED SELECT r_regionkey FROM t WHERE r_regionkey = 1").select(F.col("plan"))
    return plan.select(F.col("plan").contains("Scan parquet").alias("scans"), F.col("plan").contains("EqualTo(r_regionkey,1)").alias("filters"), F.col("plan").rlike(r"ReadSchema: struct<r_regionkey:int>\s").alias("prunes"))


SCHEMA_TABLES = {
    "schemata": ("schema_name, default_character_set_name", "SELECT 'default' AS schema_name, 'utf8mb4' AS default_character_set_name"),
    "tables": ("table_schema, table_name, table_type, table_rows", "SELECT 'default' AS table_schema, 't' AS table_name, 'BASE TABLE' AS table_type, count(*) AS table_rows FROM nation"),
    "table_constraints": ("table_name, constraint_name, constraint_type", "SELECT 't' AS table_name, 'PRIMARY' AS constraint_name, 'PRIMARY KEY' AS constraint_type"),
}
for _what, (_columns, _oracle) in SCHEMA_TABLES.items():
    dml(f"info_schema_{_what}", "nation", "n_nationkey, n_name", [], _oracle, key="n_nationkey", result=f"SELECT {_columns} FROM information_schema.{_what} WHERE 'information_schema.columns' <> ''")


@query("info_schema_columns", "SELECT 't' AS table_name, column_name, ordinal FROM (VALUES ('n_nationkey', 1), ('n_name', 2)) v(column_name, ordinal)")
def info_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "nation", "n_nationkey, n_name").information_schema("columns").select("table_name", "column_name", F.col("ordinal_position").cast("int").alias("ordinal"))


@query("info_schema_keys", "SELECT 't' AS table_name, 'PRIMARY' AS constraint_name, 'n_nationkey' AS column_name")
def info_schema_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "nation", "n_nationkey, n_name", key="n_nationkey").information_schema("key_column_usage").select("table_name", "constraint_name", "column_name")


@query("export_csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def export_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, to = engine(spark, sf_dir, "customer", C), scratch(spark)
    e.sql(f"EXPORT TABLE t TO '{to}/csv' FORMAT AS csv")
    e.sql(f"IMPORT TABLE t FROM '{to}/csv' FORMAT AS csv")
    return e.sql("SELECT * FROM t")


@query("export_parquet", "SELECT r_regionkey, r_name FROM region")
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, to = engine(spark, sf_dir, "region", "r_regionkey, r_name"), scratch(spark)
    e.sql(f"EXPORT TABLE t TO '{to}/p' FORMAT AS parquet")
    return spark.read.parquet(f"{to}/p")


@query("backup_restore", "SELECT n_nationkey, n_name FROM nation")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", "n_nationkey, n_name")
    for s in (f"CREATE REPOSITORY r WITH LOCATION '{scratch(spark)}'", "BACKUP DATABASE default TO r AS b1", "DROP TABLE t", "RESTORE DATABASE default FROM r AS b1"):
        e.sql(s)
    return e.sql("SELECT * FROM t")


@query("tunnel_row_range", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 500")
def tunnel_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tunnel import download

    return download(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, 100)


@query("tunnel_upload", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def tunnel_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tunnel import Upload

    e, n = engine(spark, sf_dir, "nation", "n_nationkey, n_name", "n_nationkey < 5"), load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    up = Upload(e.lake, "t")
    for block, where in ((0, "n_nationkey BETWEEN 5 AND 9"), (1, "n_nationkey >= 10"), (1, "n_nationkey BETWEEN 10 AND 19"), (2, "n_nationkey > 19")):
        up.send(block, n.filter(where))
    up.commit([1, 0])
    return e.sql("SELECT * FROM t")


# ---- statistics

STATS = ["c_custkey", "c_nationkey", "c_mktsegment"]


@query("stats_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM customer" for c in STATS))
def stats_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_stats(load(spark, sf_dir, "customer"), STATS, exact=True)


@query("stats_histogram", "SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 1 ELSE 0 END), 9) AS share FROM orders GROUP BY o_orderstatus")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows in a range, of each status whose histogram's guess is near it."""
    o = load(spark, sf_dir, "orders")
    guesses = [(s, Histogram.of(o.filter(F.col("o_orderstatus") == s), "o_totalprice").share(100_000, 300_000)) for s in ("F", "O", "P")]
    real = o.groupBy("o_orderstatus").agg(F.round(F.avg(F.col("o_totalprice").between(100_000, 300_000).cast("double")), 9).alias("share"))
    guessed = spark.createDataFrame(guesses, "o_orderstatus string, guess double")
    return real.join(guessed, "o_orderstatus").filter(F.abs(F.col("share") - F.col("guess")) < 0.05).select("o_orderstatus", "share")


# ---- documents, series, vectors, keys, search

@query("doc_find", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) < 60")
def doc_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.find(load(spark, sf_dir, "events"), {"k": {"$gte": 50, "$lt": 60}}, json="props").select("event_id")


@query("doc_find_columns", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value > 300 AND regexp_matches(event_type, '^c') OR user_id = 3")
def doc_find_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.find(load(spark, sf_dir, "events"), {"$or": [{"event_type": {"$in": ["click", "view"], "$regex": "^c"}, "value": {"$gt": 300}}, {"user_id": 3}]}).select("event_id")


@query("doc_update", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS event_type, CASE WHEN event_type = 'error' THEN user_id + 1000 ELSE user_id END AS user_id FROM events")
def doc_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.changed(load(spark, sf_dir, "events"), {"event_type": "error"}, {"$set": {"event_type": "fault"}, "$inc": {"user_id": 1000}}).select("event_id", "event_type", "user_id")


@query("doc_group", "SELECT event_type AS _id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY event_type")
def doc_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = doc.pipeline(load(spark, sf_dir, "events"), [{"$group": {"_id": "$event_type", "n": {"$count": {}}, "total": {"$sum": "$value"}, "top": {"$max": "$value"}}}])
    return out.withColumn("total", F.round("total", 2))


@query("doc_pipeline", "SELECT user_id AS _id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 2 ORDER BY n DESC, _id LIMIT 10 OFFSET 5")
def doc_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.pipeline(load(spark, sf_dir, "events"), [{"$match": {"event_type": "purchase"}}, {"$group": {"_id": "$user_id", "n": {"$count": {}}}}, {"$match": {"n": {"$gt": 2}}}, {"$sort": {"n": -1, "_id": 1}}, {"$skip": 5}, {"$limit": 10}])


@query("vec_topk", "SELECT vec_id, round(score, 4) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings) t ORDER BY t.score DESC, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()["embedding"]
    return stores.nearest(e, q, 10).withColumn("score", F.round("score", 4))


@query("ts_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def ts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.time_range(load(spark, sf_dir, "events"), "ts", "2024-01-10", "2024-01-12").select("event_id", "ts")


@query("ts_last_write", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def ts_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.last_write(load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("ts_line_protocol", "SELECT 'cpu' AS measurement, 'u' || user_id AS host, value AS load, CAST(event_id AS DOUBLE) AS n, epoch_us(ts) * 1000 AS ts FROM events")
def ts_line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines and read back."""
    lines = load(spark, sf_dir, "events").select(F.concat(F.lit("cpu,host=u"), "user_id", F.lit(" load="), "value", F.lit(",n="), "event_id", F.lit('i,note="a, b=c",up=t '), F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("value"))
    out = stores.parse_lines(lines.unionAll(spark.createDataFrame([("# comment",), ("",)], "value string")))
    return out.select("measurement", F.col("tags.host").alias("host"), stores.field_number(F.col("fields"), "load").alias("load"), stores.field_number(F.col("fields"), "n").alias("n"), "ts")


@query("key_range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000 ORDER BY o_orderkey LIMIT 200")
def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.key_range(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 5000, 200)


@query("key_put_rows", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'put' ELSE n_name END AS n_name FROM nation")
def key_put_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return stores.put_rows(n.select("n_nationkey", "n_name"), n.filter("n_regionkey = 1").select("n_nationkey", F.lit("put").alias("n_name")), ["n_nationkey"])


@query("kv_keys_live", "SELECT 'user:' || user_id || ':' || event_type AS key, count(*) AS n FROM events WHERE user_id BETWEEN 10 AND 19 AND event_type LIKE 'c%' AND ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def kv_keys_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id", F.lit(":"), "event_type").alias("key"), F.col("ts").alias("expires_at"))
    return stores.keys_like(stores.live(e, F.lit("2024-01-15").cast("timestamp_ntz")), "user:1?:c*").groupBy("key").agg(F.count("*").alias("n"))


@query("kv_zrange", "SELECT * FROM (SELECT event_type AS key, event_id AS member, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS INTEGER) AS rank FROM events) t WHERE rank BETWEEN 2 AND 6")
def kv_zrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("member"), F.col("value").alias("score"))
    return stores.zrange(e, 2, 6).select("key", "member", "rank")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hashes, their orders as lists and sorted sets, their statuses as sets, their names as strings."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    key = lambda p, k: F.concat(F.lit(p), F.col(k))
    out = kv.put(kv.empty(spark), kv.elements(c, "string", key("name:", "c_custkey"), F.col("c_name")), "string")
    out = kv.put(out, kv.elements(c.select("c_custkey", F.explode(F.create_map(F.lit("seg"), "c_mktsegment", F.lit("bal"), F.col("c_acctbal").cast("string"))).alias("f", "v")), "hash", key("cust:", "c_custkey"), F.col("v"), field=F.col("f")), "hash")
    out = kv.push(out, kv.elements(o, "list", key("orders:", "o_custkey"), F.col("o_orderkey"), pos=F.col("o_orderkey")))
    return kv.put(out, kv.elements(o, "set", key("status:", "o_custkey"), F.col("o_orderstatus")), "set")


@query("kv_sizes", """SELECT 'name:' || c_custkey AS key, 'string' AS kind, CAST(length(c_name) AS BIGINT) AS n FROM customer UNION ALL SELECT 'cust:' || c_custkey, 'hash', 2 FROM customer
 UNION ALL SELECT 'orders:' || o_custkey, 'list', count(*) FROM orders GROUP BY o_custkey UNION ALL SELECT 'status:' || o_custkey, 'set', count(DISTINCT o_orderstatus) FROM orders GROUP BY o_custkey""")
def kv_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.sizes(_store(spark, sf_dir))


@query("kv_lrange", "SELECT 'orders:' || o_custkey AS key, CAST(rn - 1 AS INTEGER) AS index, CAST(o_orderkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) t WHERE rn - 1 >= n - 2")
def kv_lrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.lrange(_store(spark, sf_dir), -2, -1)


@query("kv_incr_rename", "SELECT CASE WHEN event_type = 'click' THEN 'clicks' ELSE event_type END AS key, CAST(2 * count(*) AS VARCHAR) AS value FROM events GROUP BY event_type")
def kv_incr_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit(1).alias("n"))
    return kv.rename(kv.incr(kv.incr(kv.empty(spark), by), by), "click", "clicks").select("key", "value")


@query("kv_mget", "SELECT 'name:' || k AS key, c_name AS value FROM (VALUES (1), (5), (7), (99999999)) v(k) LEFT JOIN customer ON c_custkey = k")
def kv_mget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(_store(spark, sf_dir), spark.createDataFrame([(f"name:{k}",) for k in (1, 5, 7, 99999999)], "key string"))


@query("kv_pops", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
 SELECT 'orders:' || o_custkey AS key, CAST(n - 1 AS BIGINT) AS left_n, max(CASE WHEN rn = 1 THEN CAST(o_orderkey AS VARCHAR) END) AS popped, max(CASE WHEN rn = n THEN CAST(o_orderkey AS VARCHAR) END) AS last FROM o GROUP BY o_custkey, n HAVING n > 1""")
def kv_pops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first element of every list, and what is left."""
    store = _store(spark, sf_dir)
    kept, popped = kv.pop(store, store.select("key"))
    left = kv.sizes(kept).filter("kind = 'list'").select("key", F.col("n").alias("left_n"))
    return left.join(popped.select("key", F.col("value").alias("popped")), "key").join(kv.lindex(kept, -1).withColumnRenamed("value", "last"), "key")


@query("kv_removals", """SELECT 'cust:' || c_custkey AS key, CAST(1 + (c_custkey % 3 <> 0)::INT AS BIGINT) AS n FROM customer UNION ALL
 SELECT 'status:' || o_custkey, count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def kv_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HDEL of a field of every third customer, SREM of one member of all sets."""
    store, c, o = _store(spark, sf_dir), load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    store = kv.remove(store, c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.lit("bal").alias("field")), "hash")
    store = kv.remove(store, o.select(F.concat(F.lit("status:"), "o_custkey").alias("key"), F.lit("F").alias("value")).distinct(), "set")
    return kv.sizes(store).filter("kind IN ('hash', 'set')").select("key", "n")


@query("kv_decr_expire", "SELECT event_type AS key, CAST(-count(*) AS VARCHAR) AS value, CASE WHEN event_type = 'view' THEN 3600 ELSE -1 END AS seconds FROM events WHERE event_type <> 'click' GROUP BY event_type")
def kv_decr_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit(1).alias("n"))
    ends = spark.sql("SELECT * FROM VALUES ('view', TIMESTAMP_NTZ '2024-01-01 01:00:00'), ('click', TIMESTAMP_NTZ '2023-12-31 00:00:00'), ('none', TIMESTAMP_NTZ '2025-01-01 00:00:00') AS v(key, expires_at)")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    store = kv.expire(kv.decr(kv.empty(spark), e), ends)
    return kv.live(store, now).select("key", "value").join(kv.ttl(store, now).select("key", F.col("seconds").cast("int").alias("seconds")), "key")


@query("kv_reads", "SELECT 'cust:' || c_custkey AS key, f AS field, CASE f WHEN 'seg' THEN c_mktsegment END AS value, f = 'seg' AS there FROM customer, (VALUES ('seg'), ('nothing')) v(f)")
def kv_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMGET and HEXISTS of two fields of every customer, of which hashes have one."""
    store, c = _store(spark, sf_dir), load(spark, sf_dir, "customer")
    asked = c.select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.explode(F.array(F.lit("seg"), F.lit("nothing"))).alias("field"))
    return kv.get(store, asked, "hash").join(kv.exists(store, asked, "hash"), ["key", "field"])


@query("search_match_all", "SELECT item_id FROM benchmark")
def search_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.match_all(load(spark, sf_dir, "benchmark")).select("item_id")


@query("search_match", "SELECT conv_id, turn FROM conversations WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9_A-Z]+'), ['the', 'of'])")
def search_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.match(load(spark, sf_dir, "conversations"), "text", "The OF").select("conv_id", "turn")


@query("search_bulk", "SELECT * FROM (VALUES ('1', 'one', 10), ('2', 'two2', 22), ('4', 'four', 4)) v(_id, name, n)")
def search_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.createDataFrame([("1", "one", 1), ("2", "two", 2), ("3", "three", 3)], "_id string, name string, n int")
    lines = ['{"index":{"_id":"1"}}', '{"name":"one","n":10}', '{"create":{"_id":"4"}}', '{"name":"four","n":4}', '{"delete":{"_id":"3"}}', '{"update":{"_id":"2"}}', '{"doc":{"name":"two2","n":22}}']
    actions = stores.ndjson_actions(spark, spark.createDataFrame(list(enumerate(lines)), "seq int, value string"), "name string, n int")
    return stores.bulk(held, actions)


# ---- dialects

def dialect(name: str, kind: str, text: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, sf_dir: run(spark, sf_dir, DIALECTS[kind](text)))


dialect("dialect_doris", "doris", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '; ') AS names, CAST(max(n_nationkey) AS SIGNED) AS top FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 1, 3 -- comment 'x'", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, CAST(max(n_nationkey) AS BIGINT) AS top FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 3 OFFSET 1")
dialect("dialect_mc", "maxcompute", "SELECT /*+ MAPJOIN(nation) */ n_name, wm_concat(',', s_name) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, string_agg(s_name, ',' ORDER BY s_name) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
dialect("dialect_lateral_view", "maxcompute", "SELECT vec_id, count(*) AS positive FROM embeddings LATERAL VIEW explode(embedding) e AS x WHERE x > 0 GROUP BY vec_id", "SELECT vec_id, count(*) AS positive FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) t WHERE x > 0 GROUP BY vec_id")
dialect("dialect_postgres", "postgres", "SELECT c_mktsegment::text AS seg, string_agg(c_name, '|' ORDER BY c_name) AS names, count(*)::int8 AS n FROM customer WHERE c_name <> 'a::text' GROUP BY c_mktsegment ORDER BY seg FETCH FIRST 3 ROWS ONLY", "SELECT c_mktsegment AS seg, string_agg(c_name, '|' ORDER BY c_name) AS names, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY seg LIMIT 3")
dialect("dialect_tsql_top", "tsql", "SELECT TOP 5 [s_suppkey], LEN(s_name) AS n, ISNULL(s_name, 'x') AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey", "SELECT s_suppkey, CAST(length(s_name) AS INTEGER) AS n, s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")


@query("sql_script", "SELECT 55 AS total, true AS caught")
def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables, loops, conditions and handlers of procedures, as SQL scripting."""
    return spark.sql("""BEGIN
      DECLARE i INT DEFAULT 0; DECLARE total INT DEFAULT 0; DECLARE caught BOOLEAN DEFAULT false;
      DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SET caught = true; SELECT total, caught; END;
      WHILE i < 10 DO SET i = i + 1; SET total = total + i; END WHILE;
      IF total = 55 THEN SELECT 1 / 0; END IF;
    END""")


dml("tsql_merge_into", "nation", "n_nationkey, n_name, n_regionkey", ["SELECT n_nationkey + 20 AS id, 'from ' || n_name AS n_name, n_regionkey INTO s FROM t WHERE n_nationkey < 10", "MERGE INTO t AS a USING s AS b ON a.n_nationkey = b.id WHEN MATCHED THEN UPDATE SET a.n_name = a.n_name || ' ' || b.n_name WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (b.id, b.n_name, b.n_regionkey)"], "SELECT n.n_nationkey, n.n_name || coalesce(' from ' || s.n_name, '') AS n_name, n.n_regionkey FROM nation n LEFT JOIN nation s ON s.n_nationkey + 20 = n.n_nationkey UNION ALL SELECT n_nationkey + 20, 'from ' || n_name, n_regionkey FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
dml(
    "tsql_procedure", "customer", "c_custkey, c_nationkey, c_acctbal",
    ["CREATE TABLE log (k INT, n BIGINT, note STRING)",
     """CREATE PROCEDURE raise_all @top INT AS BEGIN
      DECLARE @k INT = 0; DECLARE @n BIGINT;
      WHILE @k < @top BEGIN
        SET @n = (SELECT count(*) FROM t WHERE c_nationkey = @k);
        IF @k = 2 BEGIN INSERT INTO log VALUES (@k, -1, 'two; END'); END ELSE BEGIN INSERT INTO log VALUES (@k, @n, CASE WHEN @n >= 0 THEN 'counted' END); END;
        SET @k = @k + 1;
      END;
      BEGIN TRY INSERT INTO nowhere VALUES (1); END TRY BEGIN CATCH INSERT INTO log VALUES (98, length(ERROR_MESSAGE()) - length(ERROR_MESSAGE()), 'caught'); END CATCH;
      BEGIN TRY THROW 50001, 'own', 1; END TRY BEGIN CATCH INSERT INTO log VALUES (99, 0, ERROR_MESSAGE()); END CATCH;
     END""",
     "EXEC raise_all @top = 4"],
    "SELECT c.k, CASE WHEN k = 2 THEN -1 ELSE (SELECT count(*) FROM customer WHERE c_nationkey = k) END AS n, CASE WHEN k = 2 THEN 'two; END' ELSE 'counted' END AS note FROM (VALUES (0), (1), (2), (3)) c(k) UNION ALL SELECT * FROM (VALUES (98, 0, 'caught'), (99, 0, 'own')) v", result="SELECT * FROM log")


@query("tsql_cursor", "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def tsql_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", "n_nationkey, n_regionkey")
    e.lake.create("r", "r_regionkey int, r_name string")
    e.lake.insert("r", load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    e.sql("CREATE TABLE out (r_name STRING, n BIGINT)")
    e.script("""DECLARE @k INT; DECLARE @name VARCHAR(20); DECLARE c CURSOR FOR SELECT r_regionkey, r_name FROM r ORDER BY r_regionkey;
     OPEN c; FETCH NEXT FROM c INTO @k, @name;
     WHILE @@FETCH_STATUS = 0 BEGIN INSERT INTO out SELECT @name, count(*) FROM t WHERE n_regionkey = @k; FETCH NEXT FROM c INTO @k, @name; END; CLOSE c;""")
    return e.sql("SELECT * FROM out")


# ---- streams

@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tumbling(load(spark, sf_dir, "events"))


@query("stream_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(load(spark, sf_dir, "events"))


@query("stream_dedup_count", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    return ev.first_seen(e.unionAll(e)).agg(F.count("*").alias("n"))


