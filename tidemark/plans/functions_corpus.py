"""A query for each function, or for each group of functions that both engines have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..tables import load, run
from .registry import query, sql

ROWS = """(VALUES (1,'Silver Lake','river','  padded  ',260,4,-7,2.71828,'2021-03-07','2020-11-30','2021-03-07 06:45:10'),
 (2,'mellow','FIELD','mellow   ',0,-3,-64,-1.414,'2020-02-29','2020-01-01','2020-02-29 23:59:59'),
 (3,'XyzAbc','777','   field',36,8,-2,0.005,'2022-10-21','2023-05-05','2022-10-21 14:00:00'),
 (4,'','Valley','centre',199,9,-6,500.0,'2023-12-24','2023-12-01','2023-12-31 23:59:00'),
 (5,CAST(NULL AS {s}),'probe',CAST(NULL AS {s}),CAST(NULL AS INT),2,-300,0.0,CAST(NULL AS {s}),CAST(NULL AS {s}),CAST(NULL AS {s}))) AS f(id,s1,s2,s_trim,num1,num2,num_neg,num_dec,d1,d2,dt1)"""
SPARK, DUCK = ROWS.format(s="STRING"), ROWS.format(s="VARCHAR")


def _rows(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {SPARK}").withColumn("num_dec", F.col("num_dec").cast("double"))


def own(name: str, oracle: str, columns: Callable[[], dict[str, Column]]) -> None:
    """A query of helpers over the fixture; ``oracle`` is its select list after id. Columns need a session, so they are made when the query is."""
    query(f"fn_{name}", f"SELECT id, {oracle} FROM {DUCK}")(lambda spark, sf_dir: _rows(spark).select("id", *[c.alias(n) for n, c in columns().items()]))


def both(name: str, spark_list: str, duck_list: str | None = None) -> None:
    sql(f"fn_{name}", f"SELECT id, {spark_list} FROM {SPARK}", f"SELECT id, {duck_list or spark_list} FROM {DUCK}")


def day() -> Column:
    return S.to_day("d1")


def time() -> Column:
    return S.to_time("dt1")


for part, f in {"year": F.year, "month": F.month, "day": F.day, "dayofmonth": F.dayofmonth, "dayofyear": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear}.items():
    own(part, f"CAST({part}(CAST(d1 AS DATE)) AS BIGINT) AS x", lambda f=f: dict(x=f(day()).cast("long")))
own("dayofweek", "CAST(dayofweek(CAST(d1 AS DATE)) + 1 AS BIGINT) AS x", lambda: dict(x=F.dayofweek(day()).cast("long")))
for part, f in {"hour": F.hour, "minute": F.minute, "second": F.second}.items():
    own(part, f"CAST({part}(CAST(dt1 AS TIMESTAMP)) AS BIGINT) AS x", lambda f=f: dict(x=f(time()).cast("long")))
own("datediff", "CAST(datediff('day', CAST(d2 AS DATE), CAST(d1 AS DATE)) AS BIGINT) AS x", lambda: dict(x=F.datediff(day(), S.to_day("d2")).cast("long")))
own("date_format", "strftime(CAST(dt1 AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS a, strftime(CAST(dt1 AS TIMESTAMP), '%d/%m/%y') AS b, strftime(CAST(dt1 AS TIMESTAMP), '%A %B %j') AS c", lambda: dict(a=S.date_format(time(), "%Y-%m-%d %H:%i:%s"), b=S.date_format(time(), "%d/%m/%y"), c=S.date_format(time(), "%W %M %j")))
own("date_format_iso", "strftime(CAST(d1 AS DATE), '%G') || '-' || strftime(CAST(d1 AS DATE), '%V') AS a", lambda: dict(a=S.date_format(day().cast("timestamp"), "%x-%v")))
own("str_to_date", "CAST(try_strptime(d1, '%Y-%m-%d') AS DATE) AS a, CAST(NULL AS DATE) AS b", lambda: dict(a=S.str_to_date("d1", "%Y-%m-%d"), b=S.str_to_date("s2", "%Y-%m-%d")))
own("string_dates", "CAST(d1 AS DATE) AS a, CAST(d1 AS DATE) AS b, CAST(d1 AS DATE) AS c, CAST(NULL AS DATE) AS d", lambda: dict(a=day(), b=S.to_day(F.regexp_replace("d1", "-", "/")), c=S.to_day(F.regexp_replace("d1", "-", "")), d=S.to_day("s2")))
own("from_unixtime", "strftime(make_timestamp(CAST(num2 + 1700000000 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS x", lambda: dict(x=S.from_unixtime((F.col("num2") + 1700000000).cast("long"))))
own("unix_timestamp", "CAST(epoch(CAST(dt1 AS TIMESTAMP)) AS BIGINT) AS x", lambda: dict(x=S.unix_timestamp("dt1")))
own("makedate", "CASE WHEN num2 >= 1 THEN CAST(make_date(2024, 1, 1) + (num2 - 1) AS DATE) END AS a, CAST(NULL AS DATE) AS b", lambda: dict(a=S.makedate(F.lit(2024), F.col("num2")), b=S.makedate(F.lit(2023), F.lit(366))))
own("maketime", "printf('%02d:%02d:%02d', 7, id, 5) AS x", lambda: dict(x=S.maketime(F.lit(7), F.col("id"), F.lit(5))))
own("last_day", "CAST(last_day(CAST(d1 AS DATE)) AS DATE) AS x", lambda: dict(x=F.last_day(day())))
own("date_add", "CAST(CAST(d1 AS DATE) + num2 AS DATE) AS a, CAST(CAST(d1 AS DATE) - num2 AS DATE) AS b", lambda: dict(a=F.date_add(day(), F.col("num2")), b=F.date_sub(day(), F.col("num2"))))
own("date_trunc", "CAST(date_trunc('year', CAST(d1 AS DATE)) AS DATE) AS y, CAST(date_trunc('month', CAST(d1 AS DATE)) AS DATE) AS m, CAST(d1 AS DATE) AS d", lambda: dict(y=S.date_trunc("year", day()), m=S.date_trunc("month", day()), d=S.date_trunc("hour", day())))
own("days_add", "CAST(CAST(d1 AS DATE) + num2 AS DATE) AS x", lambda: dict(x=F.date_add(day(), F.col("num2"))))
own("months_add", "CAST(CAST(d1 AS DATE) + to_months(num2) AS DATE) AS x", lambda: dict(x=S.months_add(day(), F.col("num2"))))
own("hours_add", "CAST(dt1 AS TIMESTAMP) + to_hours(num2) AS x", lambda: dict(x=S.hours_add(time(), F.col("num2"))))
own("concat_ws", "concat_ws('-', s1, s2, s_trim) AS x", lambda: dict(x=F.concat_ws("-", "s1", "s2", "s_trim")))
own("substring_index", "CASE WHEN s1 IS NULL THEN NULL ELSE list_aggregate(split(s1, 'l')[1:2], 'string_agg', 'l') END AS a, CASE WHEN s1 IS NULL THEN NULL ELSE split(s1, 'l')[-1] END AS b", lambda: dict(a=F.substring_index("s1", "l", 2), b=F.substring_index("s1", "l", -1)))
own("substring", "substring(s1, 2, 3) AS a, substring(s1, 1, 2) AS zero, CASE WHEN length(s1) >= 3 THEN right(s1, 3) ELSE s1 END AS neg, substring(s1, 1, 4) AS clamped, CASE WHEN s1 IS NOT NULL THEN '' END AS none", lambda: dict(a=S.substring("s1", F.lit(2), F.lit(3)), zero=S.substring("s1", F.lit(0), F.lit(2)), neg=S.substring("s1", F.lit(-3)), clamped=S.substring("s1", F.lit(-100), F.lit(4)), none=S.substring("s1", F.lit(2), F.lit(-1))))
own("hex", "upper(to_hex(num1)) AS i, hex(s1) AS s", lambda: dict(i=F.hex("num1"), s=F.hex("s1")))
own("unhex", "s1 AS back, CAST(NULL AS VARCHAR) AS odd, CAST(NULL AS VARCHAR) AS bad", lambda: dict(back=S.unhex(F.hex("s1")), odd=S.unhex(F.lit("ABC")), bad=S.unhex(F.lit("zz"))))
own("truncate", "CAST(trunc(CAST(num_dec AS DOUBLE) * 100) / 100 AS DOUBLE) AS a, CAST(trunc(CAST(num_dec AS DOUBLE) / 10) * 10 AS DOUBLE) AS b", lambda: dict(a=S.truncate("num_dec", 2), b=S.truncate("num_dec", -1)))
own("if", "CASE WHEN num1 > 50 THEN 'big' WHEN num1 <= 50 THEN 'small' END AS a, CASE WHEN num1 > 50 THEN 'big' ELSE 'small' END AS b", lambda: dict(a=S.if_(F.col("num1") > 50, F.lit("big"), F.lit("small")), b=S.if_mysql(F.col("num1") > 50, F.lit("big"), F.lit("small"))))
own("ifnull", "coalesce(s1, 'none') AS a, coalesce(num1, -1) AS b", lambda: dict(a=F.ifnull("s1", F.lit("none")), b=F.ifnull("num1", F.lit(-1))))


@query("fn_volatile", "SELECT event_id, strftime(ts, '%Y') AS year FROM events")
def fn_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose value can't be known beforehand, by what must hold of them for every row."""
    e = load(spark, sf_dir, "events").withColumns({"id": F.expr("uuid()"), "now": F.current_timestamp(), "db": F.current_database(), "v": F.version()})
    ok = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & (F.to_date("now") == F.current_date()) & (F.col("now") > "2024-01-01") & (F.col("db") == "default") & F.col("v").rlike(r"^\d+\.\d+")
    return e.filter(ok).select("event_id", F.date_format("ts", "yyyy").alias("year"))


both("case_length", "upper(s1) AS u, lower(s1) AS l, CAST(char_length(s1) AS BIGINT) AS n, ucase(s2) AS uc, lcase(s2) AS lc", "upper(s1) AS u, lower(s1) AS l, CAST(length(s1) AS BIGINT) AS n, upper(s2) AS uc, lower(s2) AS lc")
both("concat_null", "concat(s1, s2) AS c, s1 || s2 AS p", "s1 || s2 AS c, s1 || s2 AS p")
both("trim", "trim(s_trim) AS t, ltrim(s_trim) AS l, rtrim(s_trim) AS r")
both("replace_reverse", "replace(s1, 'l', 'L') AS a, reverse(s1) AS b")
both("left_right", "left(s1, 3) AS a, right(s1, 2) AS b, substr(s1, 2, 2) AS c")
both("pad_repeat", "lpad(s2, 8, '*') AS a, rpad(s2, 3, '.') AS b, repeat(s2, 2) AS c, space(3) AS d", "lpad(s2, 8, '*') AS a, rpad(s2, 3, '.') AS b, repeat(s2, 2) AS c, '   ' AS d")
both("locate", "CAST(locate('l', s1) AS BIGINT) AS a, CAST(instr(s1, 'o') AS BIGINT) AS b, CAST(position('W' IN s1) AS BIGINT) AS c, CAST(locate('l', s1, 4) AS BIGINT) AS d", "CAST(instr(s1, 'l') AS BIGINT) AS a, CAST(instr(s1, 'o') AS BIGINT) AS b, CAST(position('W' IN s1) AS BIGINT) AS c, CAST(CASE WHEN instr(substr(s1, 4), 'l') > 0 THEN instr(substr(s1, 4), 'l') + 3 ELSE 0 * length(s1) END AS BIGINT) AS d")
both("rounding", "abs(num_neg) AS a, CAST(ceil(CAST(num_dec AS DOUBLE)) AS BIGINT) AS c, CAST(floor(CAST(num_dec AS DOUBLE)) AS BIGINT) AS f, CAST(round(num1 / 7.0, 2) AS DOUBLE) AS r, CAST(sign(num_neg) AS BIGINT) AS s", "abs(num_neg) AS a, CAST(ceil(CAST(num_dec AS DOUBLE)) AS BIGINT) AS c, CAST(floor(CAST(num_dec AS DOUBLE)) AS BIGINT) AS f, CAST(round(num1 / 7.0, 2) AS DOUBLE) AS r, CAST(sign(num_neg) AS BIGINT) AS s")
both("round_negative", "CAST(round(CAST(num1 * 13 AS DOUBLE) / 100) * 100 AS BIGINT) AS a, round(num1, -2) AS b", "CAST(round(CAST(num1 * 13 AS DOUBLE) / 100) * 100 AS BIGINT) AS a, round(num1, -2) AS b")
both("mod", "try_mod(num1, num2) AS m, try_mod(num1, 0) AS z", "num1 % num2 AS m, CAST(NULL AS INTEGER) AS z")
both("power_log", "power(num2, 2) AS p, pow(2.0D, num2) AS q, round(sqrt(abs(num_neg)), 8) AS s, round(exp(num2 / 10.0D), 8) AS e, round(ln(num2 * num2), 8) AS l, round(log2(num2 * num2), 8) AS l2, round(log10(num2 * num2), 8) AS l10, round(log(num2 * num2), 8) AS lg", "power(num2, 2) AS p, pow(2.0, num2) AS q, round(sqrt(abs(num_neg)), 8) AS s, round(exp(num2 / 10.0), 8) AS e, round(ln(num2 * num2), 8) AS l, round(log2(num2 * num2), 8) AS l2, round(log10(num2 * num2), 8) AS l10, round(ln(num2 * num2), 8) AS lg")
both("trig", "round(sin(num2), 8) AS s, round(cos(num2), 8) AS c, round(tan(num2), 8) AS t, round(asin(num2 / 10.0D), 8) AS a, round(acos(num2 / 10.0D), 8) AS ac, round(atan(num2), 8) AS at, round(degrees(num2), 6) AS dg, round(radians(num2), 8) AS rd, round(sinh(num2), 6) AS sh, round(cosh(num2), 6) AS ch, round(tanh(num2), 8) AS th, round(cot(num2), 8) AS ct, round(pi(), 8) AS pi", "round(sin(num2), 8) AS s, round(cos(num2), 8) AS c, round(tan(num2), 8) AS t, round(asin(num2 / 10.0), 8) AS a, round(acos(num2 / 10.0), 8) AS ac, round(atan(num2), 8) AS at, round(degrees(num2), 6) AS dg, round(radians(num2), 8) AS rd, round(sinh(num2), 6) AS sh, round(cosh(num2), 6) AS ch, round(tanh(num2), 8) AS th, round(cot(num2), 8) AS ct, round(pi(), 8) AS pi")
both("greatest_least", "greatest(num_neg, num2, 0) AS g, least(num_neg, num2, 0) AS l")
both("bits", "shiftleft(num2, 2) AS l, num2 & 6 AS a, num2 | 6 AS o, num2 ^ 6 AS x, ~num2 AS n", "CAST(num2 * 4 AS INTEGER) AS l, num2 & 6 AS a, num2 | 6 AS o, xor(num2, 6) AS x, ~num2 AS n")
both("encoding", "md5(s2) AS m, sha2(s2, 256) AS s, ascii(s2) AS a, CAST(octet_length(s2) AS BIGINT) AS o, CAST(bit_length(s2) AS BIGINT) AS b, char(64 + id) AS c, sha1(s2) AS s1", "md5(s2) AS m, sha256(s2) AS s, ascii(s2) AS a, CAST(octet_length(encode(s2)) AS BIGINT) AS o, CAST(bit_length(s2) AS BIGINT) AS b, chr(64 + id) AS c, sha1(s2) AS s1")
both("find_in_set", "CAST(find_in_set(s2, 'river,FIELD,777') AS BIGINT) AS x", "CAST(coalesce(list_position(['river', 'FIELD', '777'], s2), 0) AS BIGINT) AS x")
both("names_of_dates", "dayname(CAST(d1 AS DATE)) AS d, monthname(CAST(d1 AS DATE)) AS m", "left(dayname(CAST(d1 AS DATE)), 3) AS d, left(monthname(CAST(d1 AS DATE)), 3) AS m")
both("extract", "CAST(extract(YEAR FROM CAST(d1 AS DATE)) AS BIGINT) AS y, CAST(date_part('month', CAST(d1 AS DATE)) AS BIGINT) AS m, CAST(extract(DOW FROM CAST(d1 AS DATE)) AS BIGINT) AS w", "CAST(extract(YEAR FROM CAST(d1 AS DATE)) AS BIGINT) AS y, CAST(date_part('month', CAST(d1 AS DATE)) AS BIGINT) AS m, CAST(extract(DOW FROM CAST(d1 AS DATE)) + 1 AS BIGINT) AS w")
both("interval", "CAST(CAST(d1 AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(d1 AS DATE) - INTERVAL 10 DAY AS DATE) AS d, CAST(dt1 AS TIMESTAMP_NTZ) + INTERVAL 90 MINUTE AS t", "CAST(CAST(d1 AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(d1 AS DATE) - INTERVAL 10 DAY AS DATE) AS d, CAST(dt1 AS TIMESTAMP) + INTERVAL 90 MINUTE AS t")
both("conditional", "nullif(s1, '') AS n, coalesce(s1, s_trim, 'z') AS c, if(num2 > 0, 1, 0) AS i, nvl(num1, 7) AS v", "nullif(s1, '') AS n, coalesce(s1, s_trim, 'z') AS c, CASE WHEN num2 > 0 THEN 1 ELSE 0 END AS i, coalesce(num1, 7) AS v")
sql("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, json_array_length(concat('[', props, ']')) AS n, array_join(json_object_keys(props), ',') AS names, get_json_object(to_json(named_struct('a', user_id)), '$.a') AS back FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_array_length('[' || props || ']') AS INTEGER) AS n, array_to_string(json_keys(props), ',') AS names, json_extract_string(to_json({'a': user_id}), '$.a') AS back FROM events")
query("fn_json_group", """SELECT event_id, json_valid(props) AS ok, json_valid(event_type) AS word_ok, CASE WHEN user_id % 2 = 0 THEN '["k"]' ELSE '["k","t"]' END AS names, CAST(json_extract_string(props, '$.k') AS INT) < 50 AS low,
 '{"u":' || user_id || ',"t":"' || event_type || '"}' AS made, event_type AS plain, user_id % 3 = 0 AS listed FROM events""")(
    lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", S.json_valid("props").alias("ok"), S.json_valid("event_type").alias("word_ok"),
        S.json_keys(F.when(F.col("user_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "t": 1}')))).alias("names"),
        S.json_contains(F.concat(F.lit("["), F.array_join(F.sequence(F.lit(0), F.lit(49)), ", "), F.lit("]")), F.get_json_object("props", "$.k")).alias("low"),
        S.json_object(u=F.col("user_id"), t=F.col("event_type")).alias("made"), S.json_unquote(F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("plain"),
        S.json_contains(F.lit('{"a": [0, {"b": 0}], "c": 1}'), F.concat(F.lit('{"a": [{"b": 0}], "c": '), F.when(F.col("user_id") % 3 == 0, "1").otherwise("2"), F.lit("}"))).alias("listed")))
sql("fn_array", "SELECT vec_id, size(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS first_x, CAST(array_max(slice(embedding, 1, 8)) AS DOUBLE) AS top FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first_x, CAST(list_max(embedding[1:8]) AS DOUBLE) AS top FROM embeddings")
sql("fn_map_struct", "SELECT n_nationkey, element_at(map('k', n_name, 'r', CAST(n_regionkey AS STRING)), 'r') AS r, named_struct('a', n_name).a AS a FROM nation", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS r, n_name AS a FROM nation")
sql("fn_regexp", "SELECT p_partkey, regexp_extract(p_name, '^([a-z]+)', 1) AS w, regexp_replace(p_brand, '[0-9]+', 'N') AS b, p_name RLIKE 'ring$' AS ring FROM part", "SELECT p_partkey, regexp_extract(p_name, '^([a-z]+)', 1) AS w, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS b, regexp_matches(p_name, 'ring$') AS ring FROM part")


@query("fn_sql_functions", "SELECT p_partkey, CAST(trunc(p_retailprice * 10) / 10 AS DOUBLE) AS t, CAST(p_size & 6 AS BIGINT) AS a, CAST(xor(p_size, 9) AS BIGINT) AS x, CASE WHEN p_size >= 1 THEN CAST(make_date(2023, 1, 1) + (p_size - 1) AS DATE) END AS d, CAST(~p_size AS BIGINT) AS n FROM part")
def fn_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import register

    register(spark)
    return run(spark, sf_dir, "SELECT p_partkey, truncate(p_retailprice, 1) AS t, bitand(p_size, 6) AS a, bitxor(p_size, 9) AS x, makedate(2023, p_size) AS d, bitnot(p_size) AS n FROM part")


@query("fn_dates_on_orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS w, strftime(o_orderdate, '%Y/%m') AS f, CAST(last_day(o_orderdate) AS DATE) AS l FROM orders")
def fn_dates_on_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", S.date_trunc("month", d).alias("m"), F.dayofweek(d).cast("long").alias("w"), S.date_format(d, "%Y/%m").alias("f"), F.last_day(d).alias("l"))
