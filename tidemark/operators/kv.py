"""Keys with values of five kinds as one table: (key, kind, field, pos, value, score, expires_at), a row for each element.

A string is one row; a hash has a row for each ``field``, a list for each ``pos``, a set for each ``value``, a sorted set
for each ``value`` with its ``score``. Writes give a new table; many keys are written or read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import ranked

SCHEMA = "key string, kind string, field string, pos long, value string, score double, expires_at timestamp_ntz"
#: What tells elements of a key apart.
IDENTITY = {"string": [], "hash": ["field"], "list": ["pos"], "set": ["value"], "zset": ["value"]}


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def elements(df: DataFrame, kind: str, key: Column, value: Column, *, field: Column | None = None, pos: Column | None = None, score: Column | None = None, expires_at: Column | None = None) -> DataFrame:
    """Rows of one kind from any table."""
    made = {"key": key, "kind": F.lit(kind), "field": field, "pos": pos, "value": value, "score": score, "expires_at": expires_at}
    types = dict(x.split() for x in SCHEMA.split(", "))
    return df.select(*[(c if c is not None else F.lit(None)).cast(types[n]).alias(n) for n, c in made.items()])


def put(store: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """SET, HSET, SADD and ZADD: ``new`` takes the place of the same elements; a key of another kind is replaced as a whole."""
    by = ["key", *IDENTITY[kind]]
    other = store.filter(F.col("kind") != kind).join(new.select("key").distinct(), "key", "left_anti")
    held = store.filter(F.col("kind") == kind).join(new.select(*by).distinct(), by, "left_anti")
    return other.select(*store.columns).unionByName(held.select(*store.columns)).unionByName(new.dropDuplicates(by))


def push(store: DataFrame, new: DataFrame, left: bool = False) -> DataFrame:
    """RPUSH and LPUSH: elements of ``new``, ordered by pos, behind or before those that are there."""
    ends = store.filter("kind = 'list'").groupBy("key").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    placed = ranked(new, ["pos"], "key", "at").withColumn("at", F.col("at") + 1).join(ends, "key", "left")
    pos = F.coalesce("low", F.lit(0)) - F.col("at") if left else F.coalesce("high", F.lit(-1)) + F.col("at")
    return store.unionByName(placed.withColumn("pos", pos).select(*store.columns))


def lrange(store: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, index, value) of lists, both ends included; negative ones count from the end."""
    a, b = (F.lit(x) if x >= 0 else F.col("index_n") + x for x in (start, stop))
    rows = ranked(store.filter("kind = 'list'"), ["pos"], "key", "index")
    return rows.filter(F.col("index").between(a, b)).select("key", F.col("index").cast("int").alias("index"), "value")


def lindex(store: DataFrame, index: int) -> DataFrame:
    """(key, value) of each list's element at a place, negative ones from the end; lists without it have no row."""
    return lrange(store, index, index).select("key", "value")


def pop(store: DataFrame, keys: DataFrame, n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LPOP and RPOP of the lists of ``keys`` (key): the store without the first or last ``n`` elements, and those as (key, index, value). Lists that are empty then are no keys."""
    rows = ranked(store.filter("kind = 'list'").join(keys.select("key").distinct(), "key", "left_semi").select(*store.columns), ["pos"], "key", "index")
    taken = rows.filter(F.col("index") < n if left else F.col("index") >= F.col("index_n") - n)
    kept = store.join(taken.select("key", "kind", "pos"), ["key", "kind", "pos"], "left_anti").select(*store.columns)
    return kept, taken.select("key", F.col("index").cast("int").alias("index"), "value")


def get(store: DataFrame, keys: DataFrame, kind: str = "string") -> DataFrame:
    """MGET, HMGET and ZSCORE: ``keys`` has key, for hashes field and for sorted sets value, too. All its rows come, with null for what isn't there."""
    by = ["key", *IDENTITY[kind]]
    found = "score" if kind == "zset" else "value"
    return keys.select(*by).join(store.filter(F.col("kind") == kind).select(*by, found), by, "left")


def members(store: DataFrame, kind: str) -> DataFrame:
    """HGETALL, HKEYS, HVALS and SMEMBERS of all keys: (key, field, value), (key, value) or (key, value, score)."""
    shown = {"string": ["value"], "hash": ["field", "value"], "list": ["pos", "value"], "set": ["value"], "zset": ["value", "score"]}[kind]
    return store.filter(F.col("kind") == kind).select("key", *shown)


def exists(store: DataFrame, keys: DataFrame, kind: str | None = None) -> DataFrame:
    """EXISTS, HEXISTS and SISMEMBER: the rows of ``keys``, with ``there``."""
    by = ["key", *(IDENTITY[kind] if kind else [])]
    held = (store.filter(F.col("kind") == kind) if kind else store).select(*by).distinct().withColumn("there", F.lit(True))
    return keys.select(*by).join(held, by, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def remove(store: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    """HDEL, SREM and ZREM: the elements of ``gone`` (key, and field or value) go; other kinds with such a key stay."""
    by = ["key", *IDENTITY[kind]]
    return store.join(gone.select(*by).withColumn("kind", F.lit(kind)), [*by, "kind"], "left_anti").select(*store.columns)


def decr(store: DataFrame, by: DataFrame) -> DataFrame:
    """DECRBY for many keys."""
    return incr(store, by.withColumn("n", -F.col("n")))


def expire(store: DataFrame, ends: DataFrame) -> DataFrame:
    """EXPIRE and PERSIST: ``ends`` has key and expires_at, null for no end. A key that isn't there gets none."""
    new = ends.select("key", F.col("expires_at").cast("timestamp_ntz").alias("__end"), F.lit(True).alias("__set"))
    return store.join(new, "key", "left").withColumn("expires_at", F.when(F.col("__set"), F.col("__end")).otherwise(F.col("expires_at"))).select(*store.columns)


def live(store: DataFrame, now: Column) -> DataFrame:
    """The keys that haven't ended."""
    return store.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def incr(store: DataFrame, by: DataFrame) -> DataFrame:
    """INCRBY for many keys: ``by`` has key and n; a key that isn't there starts at 0."""
    sums = by.groupBy("key").agg(F.sum("n").alias("n"))
    old = store.filter("kind = 'string'").select("key", "value", "expires_at")
    new = sums.join(old, "key", "left").select("key", (F.coalesce(F.col("value").cast("long"), F.lit(0)) + F.col("n")).alias("n"), "expires_at")
    return put(store, elements(new, "string", F.col("key"), F.col("n"), expires_at=F.col("expires_at")), "string")


def append(store: DataFrame, tail: DataFrame) -> DataFrame:
    """APPEND: ``tail`` has key and value."""
    old = store.filter("kind = 'string'").select("key", F.col("value").alias("was"))
    new = tail.join(old, "key", "left").select("key", F.concat(F.coalesce("was", F.lit("")), "value").alias("value"))
    return put(store, elements(new, "string", F.col("key"), F.col("value")), "string")


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti").select(*store.columns)


def rename(store: DataFrame, old: str, new: str) -> DataFrame:
    """``new`` goes if ``old`` is there."""
    there = store.filter(F.col("key") == old).select(F.lit(new).alias("key")).distinct()
    return delete(store, there).withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def sizes(store: DataFrame) -> DataFrame:
    """(key, kind, n): STRLEN, HLEN, LLEN, SCARD and ZCARD of all keys, with TYPE."""
    n = F.when(F.first("kind") == "string", F.max(F.length("value"))).otherwise(F.count(F.lit(1)))
    return store.groupBy("key").agg(F.first("kind").alias("kind"), n.cast("long").alias("n"))


def ttl(store: DataFrame, now: Column) -> DataFrame:
    """(key, seconds): -1 without an end; ended keys are gone."""
    left = F.timestamp_diff("SECOND", now, F.col("expires_at"))
    return store.select("key", "expires_at").distinct().filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key", F.coalesce(left, F.lit(-1)).alias("seconds"))
