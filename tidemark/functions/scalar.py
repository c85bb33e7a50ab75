"""MySQL-flavoured scalar functions as Column helpers, and as SQL functions that Catalyst inlines.

Dates may come as strings in one of five fixed forms; any other string is null rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The forms of dates and times that strings may have.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd")
TIME_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
#: MySQL's codes of date_format and the patterns that mean the same here.
FORMAT_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "S": "ss", "W": "EEEE", "M": "MMMM", "b": "MMM", "a": "EEE", "T": "HH:mm:ss", "r": "hh:mm:ss a", "f": "SSSSSS", "j": "DDD", "c": "M", "e": "d", "k": "H", "l": "h", "p": "a", "h": "hh", "I": "hh"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_day(x: Column | str) -> Column:
    """A date from a string in one of DATE_FORMS."""
    return F.coalesce(*[F.try_to_timestamp(col(x), F.lit(f)) for f in DATE_FORMS]).cast("date")


def to_time(x: Column | str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col(x), F.lit(f)) for f in TIME_FORMS])


def pattern(codes: str) -> str:
    """The pattern for a MySQL format. ``%x`` and ``%v`` (ISO year and week) have none, see ``date_format``."""
    out, quoted, i = "", "", 0

    def flush() -> str:
        plain = not any(c.isalpha() or c in "[]{}#'" for c in quoted)
        return quoted if plain else "'" + quoted.replace("'", "''") + "'"

    while i < len(codes):
        if codes[i] == "%" and i + 1 < len(codes):
            i += 1
            if codes[i] in FORMAT_CODES:
                out, quoted = out + flush() + FORMAT_CODES[codes[i]], ""
            else:
                quoted += codes[i]
        else:
            quoted += codes[i]
        i += 1
    return out + flush()


def date_format(x: Column | str, codes: str) -> Column:
    """Pieces between ISO year (%x) and ISO week (%v) are formatted one by one."""
    out, rest = [], codes
    while True:
        at = min((p for p in (rest.find("%x"), rest.find("%v")) if p >= 0), default=-1)
        piece = rest if at < 0 else rest[:at]
        if piece:
            out.append(F.date_format(col(x), pattern(piece)))
        if at < 0:
            break
        iso = F.extract(F.lit("YEAROFWEEK"), col(x).cast("date")) if rest[at + 1] == "x" else F.weekofyear(col(x))
        out.append(F.lpad(iso.cast("string"), 4 if rest[at + 1] == "x" else 2, "0"))
        rest = rest[at + 2 :]
    return F.concat(*out) if len(out) > 1 else out[0] if out else F.lit("")


def str_to_date(x: Column | str, codes: str) -> Column:
    return F.try_to_timestamp(col(x), F.lit(pattern(codes))).cast("date")


def from_unixtime(x: Column | str) -> Column:
    return F.from_unixtime(col(x), "yyyy-MM-dd HH:mm:ss")


def unix_timestamp(x: Column | str) -> Column:
    return F.unix_timestamp(to_time(x))


def makedate(year: Column | str, day: Column | str) -> Column:
    """Null unless the year has such a day."""
    out = F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), col(day) - 1)
    return F.when((col(day) >= 1) & (F.year(out) == col(year)), out)


def maketime(h: Column | str, m: Column | str, s: Column | str) -> Column:
    return F.format_string("%02d:%02d:%02d", col(h), col(m), col(s))


def date_trunc(unit: str, x: Column | str) -> Column:
    """Always a date: years and months are truncated, other units leave it as it is."""
    return F.trunc(col(x), unit) if unit.lower() in ("year", "month") else col(x).cast("date")


def months_add(x: Column | str, n: Column | int) -> Column:
    return F.add_months(col(x), n)


def hours_add(x: Column | str, n: Column | str) -> Column:
    return col(x).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), col(n))


def substring(x: Column | str, at: Column, length: Column | None = None) -> Column:
    """1-based; 0 counts as 1; from the end if negative, but never before the start; a negative length gives ''."""
    s, p = col(x), at
    first = F.when(p == 0, F.lit(1)).when(p < 0, F.greatest(F.lit(1), F.length(s) + p + 1)).otherwise(p)
    return F.substring(s, first, F.greatest(F.lit(0), length) if length is not None else F.length(s))


def unhex(x: Column | str) -> Column:
    """Text, or null for an odd length or what isn't hexadecimal."""
    s = col(x)
    return F.when((F.length(s) % 2 == 0) & s.rlike("^[0-9A-Fa-f]*$"), F.decode(F.unhex(s), "UTF-8"))


def truncate(x: Column | str, digits: Column | int) -> Column:
    """Towards zero; digits may be negative."""
    d = F.lit(digits) if isinstance(digits, int) else digits
    scale = F.pow(F.lit(10.0), d)
    y = col(x).cast("double") * scale
    return F.when(y >= 0, F.floor(y)).otherwise(F.ceil(y)) / scale


def if_(condition: Column, a: Column, b: Column) -> Column:
    """A null condition gives null."""
    return F.when(condition, a).when(~condition, b)


def if_mysql(condition: Column, a: Column, b: Column) -> Column:
    """A null condition gives ``b``."""
    return F.when(condition, a).otherwise(b)


#: SQL functions under names that no built-in has: (arguments, result, expression).
_DAY = "coalesce({})".format(", ".join(f"CAST(try_to_timestamp(s, \"{f}\") AS DATE)" for f in DATE_FORMS))
SQL_FUNCTIONS = {
    "str_day": ("s STRING", "DATE", _DAY),
    "truncate": ("n DOUBLE, d INT", "DOUBLE", "CASE WHEN n >= 0 THEN floor(n * pow(10, d)) ELSE ceil(n * pow(10, d)) END / pow(10, d)"),
    "makedate": ("y INT, d INT", "DATE", "CASE WHEN d >= 1 AND year(date_add(make_date(y, 1, 1), d - 1)) = y THEN date_add(make_date(y, 1, 1), d - 1) END"),
    "maketime": ("h BIGINT, m BIGINT, s BIGINT", "STRING", "format_string('%02d:%02d:%02d', h, m, s)"),
    "days_add": ("d DATE, n INT", "DATE", "date_add(d, n)"),
    "months_add": ("d DATE, n INT", "DATE", "add_months(d, n)"),
    "hours_add": ("t TIMESTAMP_NTZ, n INT", "TIMESTAMP_NTZ", "t + make_dt_interval(0, n)"),
    "bitand": ("a BIGINT, b BIGINT", "BIGINT", "a & b"),
    "bitor": ("a BIGINT, b BIGINT", "BIGINT", "a | b"),
    "bitxor": ("a BIGINT, b BIGINT", "BIGINT", "a ^ b"),
    "bitnot": ("a BIGINT", "BIGINT", "~a"),
    "mysql_if_null": ("c BOOLEAN, a STRING, b STRING", "STRING", "CASE WHEN c THEN a WHEN NOT c THEN b END"),
    "mysql_substring": ("s STRING, p INT, n INT", "STRING", "substring(s, CASE WHEN p = 0 THEN 1 WHEN p < 0 THEN greatest(1, length(s) + p + 1) ELSE p END, greatest(0, n))"),
    "mysql_unhex": ("s STRING", "STRING", "CASE WHEN length(s) % 2 = 0 AND s RLIKE '^[0-9A-Fa-f]*$' THEN decode(unhex(s), 'UTF-8') END"),
    "mysql_date_trunc": ("u STRING, d DATE", "DATE", "CASE WHEN lower(u) = 'year' THEN trunc(d, 'year') WHEN lower(u) = 'month' THEN trunc(d, 'month') ELSE d END"),
    "mysql_mod": ("a BIGINT, b BIGINT", "BIGINT", "try_mod(a, b)"),
}


def register(spark: SparkSession) -> None:
    """The SQL functions, for the session. Catalyst puts their expressions in place of the calls, so none runs Python."""
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")


# ---- JSON


def json_valid(s: Column | str) -> Column:
    """Null for null."""
    return F.when(col(s).isNotNull(), F.try_parse_json(col(s)).isNotNull())


def json_keys(s: Column | str) -> Column:
    """The names of an object, as a JSON array; null for what isn't one."""
    return F.to_json(F.json_object_keys(col(s)))


def json_object(**values: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]), {"ignoreNullFields": "false"})


def json_unquote(s: Column | str) -> Column:
    """What a JSON string stands for; anything else as it is."""
    return F.when(col(s).rlike('^".*"$'), F.get_json_object(F.concat(F.lit("["), col(s), F.lit("]")), "$[0]")).otherwise(col(s))


#: How deep arrays and objects may be nested for json_contains; deeper levels have to be equal.
JSON_LEVELS = 4


def json_contains(target: Column | str, candidate: Column | str) -> Column:
    """Whether ``target`` has ``candidate``: an object's members, an array's elements one by one, or an array's element."""

    def within(a: Column, b: Column, left: int) -> Column:
        same = F.to_json(a) == F.to_json(b)
        if not left:
            return same
        kind = [F.schema_of_variant(x) for x in (a, b)]
        parts = [F.try_variant_get(x, "$", "array<variant>") for x in (a, b)]
        maps = [F.try_variant_get(x, "$", "map<string,variant>") for x in (a, b)]
        an_array, an_object = ([k.startswith(w) for k in kind] for w in ("ARRAY", "OBJECT"))
        each = F.forall(parts[1], lambda y: F.exists(parts[0], lambda x: within(x, y, left - 1)))
        members = F.forall(F.map_keys(maps[1]), lambda k: F.coalesce(within(F.element_at(maps[0], k), F.element_at(maps[1], k), left - 1), F.lit(False)))
        return F.when(an_array[0] & an_array[1], each).when(an_array[0], F.exists(parts[0], lambda x: within(x, b, left - 1))).when(an_object[0] & an_object[1], members).otherwise(same)

    return within(F.try_parse_json(col(target)), F.try_parse_json(col(candidate)), JSON_LEVELS - 2)
