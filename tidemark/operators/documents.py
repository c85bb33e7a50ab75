"""Document queries: filters as dictionaries, updates, and pipelines of stages, over structs or JSON text."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(path: str, json: str | None = None) -> Column:
    """A dotted path: of columns and structs, or of the JSON text in the column ``json`` (as text)."""
    return F.get_json_object(json, f"$.{path}") if json else F.col(path)


def _compared(c: Column, value: Any, json: str | None) -> tuple[Column, Column]:
    """JSON text compares as a number with numbers."""
    if json and isinstance(value, (int, float)) and not isinstance(value, bool):
        return c.try_cast("double"), F.lit(float(value))
    return c, F.lit(str(value).lower() if json and isinstance(value, bool) else value)


def condition(query: dict[str, Any], json: str | None = None) -> Column:
    """$eq $ne $gt $gte $lt $lte $in $nin $regex $exists, $and $or $not; a missing field fails an equality and passes $ne."""
    parts: list[Column] = []
    for key, want in query.items():
        if key in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, [condition(q, json) for q in want]))
            continue
        c = field(key, json)
        if not (isinstance(want, dict) and any(k.startswith("$") for k in want)):
            want = {"$eq": want}
        for op, value in want.items():
            if op == "$exists":
                parts.append(c.isNotNull() if value else c.isNull())
            elif op == "$regex":
                parts.append(F.coalesce(c.cast("string").rlike(value), F.lit(False)))
            elif op in ("$in", "$nin"):
                pairs = [_compared(c, v, json) for v in value]
                hit = reduce(lambda a, b: a | b, [F.coalesce(x == y, F.lit(False)) for x, y in pairs], F.lit(False))
                parts.append(hit if op == "$in" else ~hit)
            elif op == "$not":
                parts.append(~condition({key: value}, json))
            elif op == "$eq" and value is None:
                parts.append(c.isNull())
            else:
                x, y = _compared(c, value, json)
                test = {"$eq": x == y, "$ne": ~F.coalesce(x == y, F.lit(False)), "$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}.get(op)
                if test is None:
                    raise ValueError(f"no such operator: {op}")
                parts.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def find(df: DataFrame, query: dict[str, Any], json: str | None = None) -> DataFrame:
    return df.filter(condition(query, json))


def changed(df: DataFrame, query: dict[str, Any], update: dict[str, dict[str, Any]]) -> DataFrame:
    """$set and $inc, nested paths too, of the rows that the query finds."""
    hit = condition(query)
    out = df.withColumn("__hit", hit)
    for op, values in update.items():
        for path, v in values.items():
            new = F.lit(v) if op == "$set" else field(path) + F.lit(v)
            head, _, rest = path.partition(".")
            value = F.col(head).withField(rest, new) if rest else new
            out = out.withColumn(head, F.when(F.col("__hit"), value).otherwise(F.col(head)))
    return out.drop("__hit")


ACCUMULATORS = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$push": F.collect_list, "$addToSet": F.collect_set}


def _value(x: Any, json: str | None) -> Column:
    return field(x[1:], json) if isinstance(x, str) and x.startswith("$") else F.lit(x)


def pipeline(df: DataFrame, stages: list[dict[str, Any]], json: str | None = None) -> DataFrame:
    """$match $group $project $sort $skip $limit $count $unwind, each on what the one before gives."""
    for stage in stages:
        (op, x), *_ = stage.items()
        if op == "$match":
            df = find(df, x, json if json and json in df.columns else None)
        elif op == "$group":
            made = [F.count(F.lit(1)).alias(n) if "$count" in a else ACCUMULATORS[(k := next(iter(a)))](_value(a[k], json)).alias(n) for n, a in x.items() if n != "_id"]
            df = df.groupBy(_value(x["_id"], json).alias("_id")).agg(*made) if made else df.select(_value(x["_id"], json).alias("_id")).distinct()
            json = None
        elif op == "$project":
            df = df.select(*[(field(n, json) if v == 1 else _value(v, json)).alias(n.split(".")[-1]) for n, v in x.items() if v != 0])
        elif op == "$sort":
            df = df.orderBy(*[F.col(n).asc_nulls_first() if d > 0 else F.col(n).desc_nulls_last() for n, d in x.items()])
        elif op == "$skip":
            df = df.offset(x)
        elif op == "$limit":
            df = df.limit(x)
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(x))
        elif op == "$unwind":
            name = (x if isinstance(x, str) else x["path"])[1:]
            df = df.withColumn(name, F.explode(name))
        else:
            raise ValueError(f"no such stage: {op}")
    return df
