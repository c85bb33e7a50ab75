"""Rewrites of other dialects to Spark SQL, on text whose string literals and comments are masked first."""

from __future__ import annotations

import re
from collections.abc import Callable

MASKED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*(?!\+).*?\*/", re.S)
HOLE = "\x00{}\x00"


class Masked:
    """text: a statement whose string literals are holes, and whose comments are gone (or stay, without ``comments``)."""

    def __init__(self, text: str, comments: bool = True) -> None:
        self.kept: list[str] = []

        def hide(m: re.Match) -> str:
            if m[0][:2] in ("--", "/*") and comments:
                return " "
            self.kept.append(m[0])
            return HOLE.format(len(self.kept) - 1)

        self.text = MASKED.sub(hide, text)

    def whole(self, text: str) -> str:
        """A part of the text with its literals again."""
        return re.sub(r"\x00(\d+)\x00", lambda m: self.kept[int(m[1])], text)

    def value(self, hole: str) -> str:
        """What the literal of a hole stands for."""
        held = self.whole(hole)
        return re.sub(r"\\(.)", r"\1", held[1:-1].replace(held[0] * 2, held[0]), flags=re.S)


def masked(text: str, change: Callable[[str], str]) -> str:
    """``change`` of the text without its literals, which then come back; comments don't."""
    held = Masked(text)
    return held.whole(change(held.text))


def _sub(*rules: tuple[str, str]) -> Callable[[str], str]:
    def change(text: str) -> str:
        for pattern, to in rules:
            text = re.sub(pattern, to, text, flags=re.I)
        return text

    return change




def doris(text: str) -> str:
    """MySQL and Doris: whole quotients stay (``DIV``), GROUP_CONCAT with ORDER BY and SEPARATOR, SIGNED casts, LIMIT a, b."""

    def change(t: str) -> str:
        t = re.sub(r"group_concat\s*\(\s*(distinct\s+)?([^()]*?(?:\([^()]*\)[^()]*?)*?)(?:\s+order\s+by\s+([^()]*?))?(?:\s+separator\s+(\x00\d+\x00))?\s*\)", lambda m: f"listagg({m[1] or ''}{m[2]}, {m[4] or COMMA}) WITHIN GROUP (ORDER BY {m[3] or m[2]})", t, flags=re.I)
        t = _sub((r"\bas\s+(?:signed|unsigned)(?:\s+integer)?\b", "AS BIGINT"), (r"\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1"), (r"\bunix_timestamp\s*\(\s*\)", "unix_timestamp()"))(t)
        return _sub((r"\badddate\s*\(", "date_add("), (r"\bsubdate\s*\(", "date_sub("), (r"\bmod\s*\(", "try_mod("), (r"\bmysql_version\s*\(\s*\)", "version()"))(t)

    COMMA = "','"
    return masked(text, change)


def maxcompute(text: str) -> str:
    """Mostly Spark's own SQL already; hints that only say how to join go, as Spark knows the tables' sizes, and lifecycles and z-orders go."""
    return masked(text, _sub((r"/\*\+\s*mapjoin\s*\([^)]*\)\s*\*/", ""), (r"/\*\+\s*skewjoin\s*\([^)]*\)\s*\*/", ""), (r"\blifecycle\s+\d+", ""), (r"\bzorder\s+by\s+[\w, ]+", ""), (r"\bwm_concat\s*\(\s*(\x00\d+\x00)\s*,\s*(\w+)\s*\)", r"listagg(\2, \1) WITHIN GROUP (ORDER BY \2)"), (r"\bgetdate\s*\(\s*\)", "current_timestamp()"), (r"\bto_char\s*\(", "date_format("), (r"\bdatetrunc\s*\(\s*(\w+)\s*,\s*(\x00\d+\x00)\s*\)", r"date_trunc(\2, \1)")))


def postgres(text: str) -> str:
    """Casts with ``::`` are Spark's too; types, string_agg, unnest and FETCH FIRST differ."""
    return masked(text, _sub((r"::\s*(?:text|varchar(?:\(\d+\))?)", "::string"), (r"::\s*(?:int4|integer)", "::int"), (r"::\s*int8", "::bigint"), (r"::\s*(?:float8|double\s+precision)", "::double"), (r"\bstring_agg\s*\(\s*(\w+)\s*,\s*(\x00\d+\x00)\s*(?:order\s+by\s+([\w, ]+))?\)", lambda m: f"listagg({m[1]}, {m[2]}) WITHIN GROUP (ORDER BY {m[3] or m[1]})"), (r"\bunnest\s*\(", "explode("), (r"\bfetch\s+first\s+(\d+)\s+rows?\s+only", r"LIMIT \1"), (r"\bnow\s*\(\s*\)", "current_timestamp()"), (r"\bgenerate_series\s*\(([^()]*)\)", r"explode(sequence(\1))")))


def tsql(text: str) -> str:
    """TOP, brackets, GETDATE, ISNULL, LEN and string ``+`` between literals."""

    def change(t: str) -> str:
        t = re.sub(r"\[(\w+)\]", r"`\1`", t)
        if m := re.search(r"\bselect\s+(distinct\s+)?top\s*\(?\s*(\d+)\s*\)?\s+", t, re.I):
            t = t[: m.start()] + f"SELECT {m[1] or ''}" + t[m.end() :].rstrip().rstrip(";") + f" LIMIT {m[2]}"
        return _sub((r"\bgetdate\s*\(\s*\)|\bsysdatetime\s*\(\s*\)", "current_timestamp()"), (r"\bgetutcdate\s*\(\s*\)", "current_timestamp()"), (r"\bisnull\s*\(", "coalesce("), (r"\blen\s*\(", "length("), (r"\bnewid\s*\(\s*\)", "uuid()"), (r"\bdb_name\s*\(\s*\)", "current_database()"), (r"(\x00\d+\x00)\s*\+\s*(\x00\d+\x00)", r"\1 || \2"), (r"\bnvarchar\b", "string"), (r"\bconvert\s*\(\s*(\w+)\s*,\s*([^()]+)\)", r"CAST(\2 AS \1)"))(t)

    return masked(text, change)


DIALECTS: dict[str, Callable[[str], str]] = {"spark": lambda t: t, "doris": doris, "maxcompute": maxcompute, "postgres": postgres, "tsql": tsql}
