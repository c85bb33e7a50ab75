"""Scripts and stored procedures: statements of an Engine with variables, conditions, loops, handlers and cursors.

Statements end with a semicolon, and what IF, ELSE and WHILE govern stands between BEGIN and END. The control flow runs on the driver, as a
client's would; the statements are distributed as ever, and a cursor gets its rows partition by partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from .dialects import Masked

WORD = re.compile(r"\x00\d+\x00|@{0,2}[A-Za-z_#]\w*|\S")
VARIABLE = re.compile(r"@@?\w+")


class ScriptError(Exception):
    """What THROW and RAISERROR raise."""


class Returned(Exception):
    pass


def parse(text: str) -> list[tuple]:
    """("do", text), ("if", condition, then, otherwise), ("while", condition, body) and ("try", body, handler), in order; literals stay masked."""
    words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    at = 0

    def word(k: int = 0) -> str:
        return words[at + k][0] if at + k < len(words) else ""

    def skip(*expected: str) -> None:
        nonlocal at
        for x in expected:
            if word() != x:
                raise ValueError(f"{x.upper()} is missing at {text[words[at][1] :][:40] if at < len(words) else 'the end'!r}")
            at += 1

    def upto(*stops: str) -> str:
        """The text before the next of these words that isn't part of a CASE."""
        nonlocal at
        start, cases = at, 0
        while at < len(words) and (cases or word() not in stops):
            cases += (word() == "case") - (word() == "end" and cases > 0)
            at += 1
        return text[words[start][1] : words[at - 1][2]] if at > start else ""

    def block(*end: str) -> list[tuple]:
        out = []
        while at < len(words) and word() != "end":
            if one := statement():
                out.append(one)
        if end:
            skip(*end)
        return out

    def statement() -> tuple | None:
        if word() == ";":
            skip(";")
            return None
        if word() == "begin" and word(1) == "try":
            skip("begin", "try")
            body = block("end", "try")
            skip("begin", "catch")
            return ("try", body, block("end", "catch"))
        if word() == "begin" and word(1) not in ("tran", "transaction", "work", ";", ""):
            skip("begin")
            return ("if", "1 = 1", block("end"), [])
        if word() in ("if", "while"):
            kind = word()
            skip(kind)
            condition = upto("begin")
            skip("begin")
            body = block("end")
            if kind == "while":
                return ("while", condition, body)
            other = []
            if word() == "else":
                skip("else")
                other = [x] if (x := statement()) else []
            return ("if", condition, body, other)
        return ("do", upto(";"))

    out = block()
    if at < len(words):
        raise ValueError("there is an END too many")
    return out


def literal(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("\\", "\\\\").replace("'", "''") + "'"


class Script:
    def __init__(self, engine, text: str, variables: dict[str, Any] | None = None) -> None:
        self.engine, self.held = engine, Masked(text)
        self.steps = parse(self.held.text)
        self.variables: dict[str, Any] = {"@@fetch_status": 0, "@@error_message": None} | (variables or {})
        self.cursors: dict[str, str | Iterator] = {}
        self.result: DataFrame | None = None

    def run(self) -> DataFrame | None:
        """The rows of the last statement that has some."""
        try:
            self._all(self.steps)
        except Returned:
            pass
        return self.result

    def _filled(self, text: str) -> str:
        text = re.sub(r"\berror_message\s*\(\s*\)", "@@error_message", text, flags=re.I)
        return self.held.whole(VARIABLE.sub(lambda m: literal(self.variables[m[0].lower()]) if m[0].lower() in self.variables else m[0], text))

    def _value(self, text: str) -> Any:
        return self.engine.query(f"SELECT {self._filled(text)} AS x").first()["x"]

    def _all(self, steps: list[tuple]) -> None:
        for kind, *rest in steps:
            if kind == "do":
                self._do(rest[0])
            elif kind == "if":
                self._all(rest[1] if self._value(rest[0]) else rest[2])
            elif kind == "while":
                while self._value(rest[0]):
                    self._all(rest[1])
            else:
                try:
                    self._all(rest[0])
                except Returned:
                    raise
                except Exception as e:  # whatever a statement raises is what a handler is for
                    self.variables["@@error_message"] = str(e).split("\n")[0]
                    self._all(rest[1])

    def _do(self, text: str) -> None:
        for pattern, f in (
            (r"declare\s+(\w+)\s+cursor\s+(?:\w+\s+)?for\s+(.+)", lambda m: self.cursors.__setitem__(m[1].lower(), m[2])),
            (r"declare\s+(@\w+)\s+(?:as\s+)?[\w(), ]+?(?:\s*=\s*(.+))?", lambda m: self._set(m[1], m[2] or "NULL")),
            (r"set\s+(@\w+)\s*=\s*(.+)", lambda m: self._set(m[1], m[2])),
            (r"open\s+(\w+)", lambda m: self.cursors.__setitem__(m[1].lower(), self.engine.query(self._filled(self.cursors[m[1].lower()])).toLocalIterator())),
            (r"fetch\s+next\s+from\s+(\w+)\s+into\s+(.+)", lambda m: self._fetch(m[1].lower(), [x.strip().lower() for x in m[2].split(",")])),
            (r"(?:close|deallocate)\s+(\w+)", lambda m: None),
            (r"throw\s+\d+\s*,\s*(.+?)\s*,\s*\d+|raiserror\s*\(\s*([^,]+),.*\)", lambda m: self._raise(m[1] or m[2])),
            (r"return\b.*", lambda m: self._return()),
            (r"print\s+.+", lambda m: None),
        ):
            if m := re.fullmatch(pattern, text.strip(), re.I | re.S):
                f(m)
                return
        out = self.engine.sql(self._filled(text))
        if out.columns != ["status"]:
            self.result = out

    def _set(self, name: str, text: str) -> None:
        self.variables[name.lower()] = self._value(text)

    def _fetch(self, name: str, into: list[str]) -> None:
        row = next(self.cursors[name], None)
        self.variables["@@fetch_status"] = 0 if row is not None else -1
        if row is not None:
            self.variables |= dict(zip(into, row, strict=True))

    def _raise(self, text: str) -> None:
        raise ScriptError(str(self._value(text)))

    def _return(self) -> None:
        raise Returned
