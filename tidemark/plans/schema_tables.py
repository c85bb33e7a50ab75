"""The catalog of a Lake as the tables of ``information_schema``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, DecimalType, StringType

from .lake import Lake

# The standard's column names.
TABLES = {
    "schemata": "catalog_name string, schema_name string, schema_owner string, default_character_set_catalog string, default_character_set_schema string, default_character_set_name string, sql_path string",
    "tables": "table_catalog string, table_schema string, table_name string, table_type string, engine string, table_rows long, data_length long, table_collation string, table_comment string",
    "columns": "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position long, column_default string, is_nullable string, data_type string, character_maximum_length long, numeric_precision long, numeric_scale long, column_type string, column_key string, extra string, column_comment string",
    "table_constraints": "constraint_catalog string, constraint_schema string, constraint_name string, table_catalog string, table_schema string, table_name string, constraint_type string",
    "key_column_usage": "constraint_catalog string, constraint_schema string, constraint_name string, table_catalog string, table_schema string, table_name string, column_name string, ordinal_position long, position_in_unique_constraint long, referenced_table_schema string, referenced_table_name string, referenced_column_name string",
}
CATALOG, CHARACTERS, COLLATION = "def", "utf8mb4", "utf8mb4_bin"
#: Decimal digits of the numbers of each type. Fixed values.
DIGITS = {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0), "float": (12, None), "double": (22, None)}


def _digits(kind: DataType) -> tuple[int | None, int | None]:
    return (kind.precision, kind.scale) if isinstance(kind, DecimalType) else DIGITS.get(kind.simpleString(), (None, None))


def _keys(lake: Lake) -> Iterator[tuple[str, str, str, list[str]]]:
    """(database, table, kind of constraint, columns)."""
    for db, tables in sorted(lake.state["databases"].items()):
        for t, x in sorted(tables.items()):
            if x["model"] in ("primary", "unique"):
                yield db, t, x["model"].upper(), x["keys"]


def _constraint(kind: str) -> str:
    return "PRIMARY" if kind == "PRIMARY" else "uk"


def _rows(lake: Lake, what: str) -> Iterator[tuple]:
    dbs = sorted(lake.state["databases"].items())
    if what == "schemata":
        yield from ((CATALOG, db, None, None, None, CHARACTERS, None) for db, _ in dbs)
    elif what == "tables":
        for db, tables in dbs:
            yield from ((CATALOG, db, t, "BASE TABLE", "parquet", *lake.size(f"{db}.{t}"), COLLATION, x["comment"]) for t, x in sorted(tables.items()))
        yield from ((CATALOG, lake.database, v, "VIEW", None, None, None, None, "") for v in sorted(lake.state["views"]))
    elif what == "columns":
        for db, tables in dbs:
            for t, x in sorted(tables.items()):
                for i, f in enumerate(lake.schema(f"{db}.{t}")):
                    kind = f.dataType
                    key = {"primary": "PRI", "unique": "UNI"}.get(x["model"], "") if f.name in x["keys"] else ""
                    length = 65535 if isinstance(kind, StringType) else None
                    yield CATALOG, db, t, f.name, i + 1, None, "YES" if f.nullable else "NO", kind.simpleString().split("(")[0], length, *_digits(kind), kind.simpleString(), key, x["aggregates"].get(f.name, ""), ""
    elif what == "table_constraints":
        yield from ((CATALOG, db, _constraint(kind), CATALOG, db, t, f"{kind} KEY" if kind == "PRIMARY" else kind) for db, t, kind, _ in _keys(lake))
    else:
        yield from ((CATALOG, db, _constraint(kind), CATALOG, db, t, c, i + 1, None, None, None, None) for db, t, kind, columns in _keys(lake) for i, c in enumerate(columns))


def schema_table(spark: SparkSession, lake: Lake, what: str) -> DataFrame:
    return spark.createDataFrame(list(_rows(lake, what)), TABLES[what])
