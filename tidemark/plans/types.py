"""Type names of CREATE TABLE and the types they stand for. Lengths of strings aren't enforced."""

from __future__ import annotations

import re

# Fixed values.
NAMES = {
    "boolean": "boolean", "bool": "boolean", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "integer": "int", "mediumint": "int", "bigint": "bigint",
    "largeint": "decimal(38,0)", "int128": "decimal(38,0)", "float": "float", "real": "float", "double": "double", "date": "date", "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz", "time": "string", "varchar": "string", "char": "string", "string": "string", "text": "string", "longtext": "string", "mediumtext": "string",
    "tinytext": "string", "binary": "binary", "varbinary": "binary", "blob": "binary", "longblob": "binary", "json": "string", "jsonb": "string", "money": "decimal(19,4)",
    "smallmoney": "decimal(10,4)", "uniqueidentifier": "string",
}


def spark_type(text: str) -> str:
    """An unknown name is a string; arrays, maps and structs are passed on."""
    t = text.strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric|number)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", t):
        return f"decimal({m[1] or 10},{m[2] or 0})"
    if re.match(r"(array|map|struct)\s*<", t):
        return t
    if m := re.fullmatch(r"vector\s*\(\s*\d+\s*\)", t):
        return "array<float>"
    return NAMES.get(re.match(r"\w+", t)[0], "string") if re.match(r"\w+", t) else "string"
