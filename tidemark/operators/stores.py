"""Query surfaces of other kinds of stores as DataFrames: time series, vectors, ordered keys, keys with values, search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import ranked

# ---- time series


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Line protocol (``name,tag=v field=1.5,other=3i time``) as measurement, tags, fields (text by name), ts (nanoseconds). Comments and other lines go."""
    x = F.col(column)
    part = F.regexp_extract
    whole = r'^([^,\s]+)((?:,[^=\s,]+=[^,\s]*)*)\s+((?:[^=\s,]+=(?:"(?:[^"\\]|\\.)*"|[^,\s]*))(?:,[^=\s,]+=(?:"(?:[^"\\]|\\.)*"|[^,\s]*))*)(?:\s+(-?\d+))?\s*$'
    good = lines.filter(~F.ltrim(x).startswith("#") & x.rlike(whole))
    pairs = F.regexp_extract_all(part(x, whole, 3), F.lit(r'([^=\s,]+=(?:"(?:[^"\\]|\\.)*"|[^,\s]*))'), F.lit(1))
    fields = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), p.substr(F.instr(p, "=") + 1, F.length(p)).alias("value"))))
    tags = F.when(part(x, whole, 2) == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(F.substring(part(x, whole, 2), 2, 1 << 30), F.lit(","), F.lit("=")))
    return good.select(part(x, whole, 1).alias("measurement"), tags.alias("tags"), fields.alias("fields"), F.nullif(part(x, whole, 4), F.lit("")).cast("long").alias("ts"))


def field_number(fields: Column, name: str) -> Column:
    """A field as a number: ``3i`` and ``1.5`` are, booleans are 1 and 0, texts are null."""
    v = fields[name]
    return F.when(v.rlike("^(?i:t|true)$"), 1.0).when(v.rlike("^(?i:f|false)$"), 0.0).otherwise(F.regexp_replace(v, "i$", "").try_cast("double"))


def last_write(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each key the row that comes last; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*[c if c in key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def time_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """[start, end), which reaches the file scan."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


# ---- vectors


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and for those without length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm).otherwise(0.0)


def nearest(df: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest cosine, by id where equal: each task keeps k, and those meet."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return df.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


# ---- ordered keys


def key_range(df: DataFrame, key: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    """[start, end) in order of the key."""
    if start is not None:
        df = df.filter(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(key) < F.lit(end))
    df = df.orderBy(key)
    return df.limit(limit) if limit is not None else df


def put_rows(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` take the place of those with equal keys."""
    return df.join(rows.select(*keys), keys, "left_anti").select(*df.columns).unionByName(rows)


# ---- keys with values


def glob_pattern(glob: str) -> str:
    """``*``, ``?`` and ``[a-c]`` as a regular expression."""
    out = re.sub(r"\\\*", ".*", re.escape(glob)).replace(r"\?", ".")
    return f"^{re.sub(r'\\\[(.*?)\\\]', lambda m: '[' + m[1].replace(chr(92), '') + ']', out)}$"


def live(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires).isNull() | (F.col(expires) > now))


def keys_like(df: DataFrame, glob: str, key: str = "key") -> DataFrame:
    return df.filter(F.col(key).rlike(glob_pattern(glob)))


def zrange(df: DataFrame, start: int, stop: int, key: str = "key", member: str = "member", score: str = "score") -> DataFrame:
    """Members by rank from ``start`` to ``stop``, both included; negative ranks count from the end."""
    at = [F.lit(x) if x >= 0 else F.col("rank_n") + x for x in (start, stop)]
    return ranked(df, [score, member], key).filter(F.col("rank").between(*at)).drop("rank_n").withColumn("rank", F.col("rank").cast("int"))


# ---- search


def match_all(df: DataFrame) -> DataFrame:
    return df


def match(df: DataFrame, column: str, query: str, all_words: bool = False) -> DataFrame:
    """Rows that have a word of the query, or every one, whatever the case; ``score`` counts them."""
    words = F.split(F.lower(column), r"\W+")
    hits = [F.array_contains(words, w).cast("int") for w in dict.fromkeys(re.findall(r"\w+", query.lower()))]
    score = reduce(lambda a, b: a + b, hits, F.lit(0))
    return df.withColumn("score", score).filter(F.col("score") >= (len(hits) if all_words else 1))


def bulk(df: DataFrame, actions: DataFrame, key: str = "_id") -> DataFrame:
    """Applies index, create, update and delete (columns seq, action, ``key`` and those of ``df``): the last action of a key counts; create never replaces, update needs the key."""
    last = last_write(actions, [key], ["seq"])
    same = F.col(f"o.{key}") == F.col(f"n.{key}")
    both = df.withColumn("__o", F.lit(True)).alias("o").join(last.alias("n"), same, "full")
    act, there = F.col("n.action"), F.col("__o").isNotNull()
    put = act.isin("index") | (act.isin("create") & ~there) | (act.isin("update") & there)
    gone = F.coalesce(act == "delete", F.lit(False)) | (act.isin("update") & ~there)
    return both.filter(~F.coalesce(gone, F.lit(False))).select(*[F.when(F.coalesce(put, F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in df.columns])


def ndjson_actions(spark: SparkSession, lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Action lines and, after all but deletes, document lines; ``lines`` has seq, which orders them."""
    lines = ranked(lines.select("seq", column), ["seq"])
    after = lines.select((F.col("rank") - 1).alias("__rank"), F.col(column).alias("doc"))
    kind = F.json_object_keys(column)[0]
    marked = lines.withColumn("action", F.when(F.get_json_object(column, "$.index._id").isNotNull() | F.get_json_object(column, "$.create._id").isNotNull() | F.get_json_object(column, "$.update._id").isNotNull() | F.get_json_object(column, "$.delete._id").isNotNull(), kind))
    named = marked.filter("action is not null").join(after, F.col("rank") == F.col("__rank"), "left").withColumn("doc", F.when(F.col("action") != "delete", F.col("doc")))
    ident = F.coalesce(*[F.get_json_object(column, f"$.{a}._id") for a in ("index", "create", "update", "delete")])
    return named.select("seq", "action", ident.alias("_id"), F.from_json(F.coalesce(F.get_json_object("doc", "$.doc"), F.col("doc")), schema).alias("d")).select("seq", "action", "_id", "d.*")
