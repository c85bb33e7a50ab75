"""Tables that change: each is a list of Parquet folders, and every statement makes a new list.

An insert adds a folder and rewrites nothing; updates and deletes write a table anew beside the old one, and then the list changes,
so readers never see half a statement. Keeping the old lists makes transactions that can be rolled back. The lists are one
small JSON file for each version; the newest counts, and it is complete as soon as it has its name. What no list names can be
removed by ``vacuum``. Rows of tables with keys carry the number of their statement and their place in it, which say what was written last.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Folder, export, imported

CATALOG = "catalog-{:012d}.json"
#: Versions of the catalog that are kept.
KEPT = 2
#: When a row was written: the statement's number and the place in it.
AT = "__at"
AT_TYPE = "struct<statement:bigint,place:bigint>"
#: What an aggregate-key table does with values of equal keys.
MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "replace": lambda c: F.max_by(F.struct(F.col(c).alias("v")), AT)["v"]}


@dataclass
class Table:
    schema: str
    parts: list[str] = field(default_factory=list)
    model: str = "duplicate"
    keys: list[str] = field(default_factory=list)
    aggregates: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    comment: str = ""
    stats: list[dict] = field(default_factory=list)

    @property
    def keyed(self) -> bool:
        return self.model in ("unique", "primary", "aggregate")


class Lake:
    def __init__(self, spark: SparkSession, root: str, most_rows: int | None = None) -> None:
        """``most_rows``: an update or delete on a table with more is refused."""
        self.spark, self.root, self.most_rows = spark, root.rstrip("/"), most_rows
        self.files = Folder(spark, self.root)
        self.saved: list[tuple[str, str]] = []
        self.state: dict = {"databases": {"default": {}}, "views": {}, "repositories": {}, "statement": 0}
        versions = self._versions()
        self.version = versions[-1] if versions else 0
        if versions:
            self.state = json.loads(self.files.read(CATALOG.format(self.version)))
        elif any(not x.startswith(".") for x in self.files.names()):
            raise ValueError(f"{self.root} has files but no catalog")
        self.database = "default"

    # ---- names

    def _split(self, name: str) -> tuple[str, str]:
        parts = name.replace("`", "").split(".")
        return (parts[-2] if len(parts) > 1 else self.database, parts[-1])

    def tables(self, database: str | None = None) -> list[str]:
        return sorted(self.state["databases"][database or self.database])

    def table(self, name: str) -> Table:
        db, t = self._split(name)
        if t not in self.state["databases"].get(db, {}):
            raise KeyError(f"there is no table {db}.{t}")
        return Table(**self.state["databases"][db][t])

    def _put(self, name: str, table: Table | None) -> None:
        db, t = self._split(name)
        if table is None:
            self.state["databases"][db].pop(t)
        else:
            self.state["databases"][db][t] = asdict(table)
        self._save()

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for x in self.files.names() if (m := re.fullmatch(r"catalog-(\d{12})\.json", x)))

    def _save(self) -> None:
        """A new version; an older one is there until that has its name. Another writer's version is an error."""
        if not self.saved:
            self.files.write(CATALOG.format(self.version + 1), json.dumps(self.state))
            self.version += 1
            for v in self._versions()[:-KEPT]:
                self.files.delete(CATALOG.format(v))

    def register(self) -> None:
        """The current tables and views as temporary views."""
        for t in self.tables():
            self.df(t).createOrReplaceTempView(t)
        for v, text in self.state["views"].items():
            self.spark.sql(text).createOrReplaceTempView(v)

    # ---- definitions

    def create_database(self, name: str, if_missing: bool = False) -> None:
        if name in self.state["databases"] and not if_missing:
            raise ValueError(f"there is a database {name}")
        self.state["databases"].setdefault(name, {})
        self._save()

    def rename_database(self, old: str, new: str) -> None:
        """The files of its tables stay where they are."""
        if new in self.state["databases"]:
            raise ValueError(f"there is a database {new}")
        self.state["databases"][new] = self.state["databases"].pop(old)
        self.state.setdefault("notes", {})[new] = self.state.get("notes", {}).pop(old, {})
        self.database = new if self.database == old else self.database
        self._save()

    def describe_database(self, name: str, **properties: str) -> None:
        if name not in self.state["databases"]:
            raise KeyError(f"there is no database {name}")
        notes = self.state.setdefault("notes", {})
        notes[name] = notes.get(name, {}) | properties
        self._save()

    def drop_database(self, name: str) -> None:
        self.state["databases"].pop(name)
        self._save()

    def create(self, name: str, schema: str, **how) -> None:
        db, t = self._split(name)
        if t in self.state["databases"][db]:
            raise ValueError(f"there is a table {db}.{t}")
        self._put(name, Table(schema, **how))

    def drop(self, name: str) -> None:
        self.table(name)
        self._put(name, None)

    def size(self, name: str) -> tuple[int, int]:
        """(rows, bytes); rows by the files' footers, where a table has no keys."""
        t = self.table(name)
        return self.df(name).count(), sum(self.files.size(p) for p in t.parts)

    def partitions(self, name: str) -> list[tuple[str, str | None, str | None]]:
        held = self.table(name).properties
        return [(k.removeprefix("partition."), *json.loads(v)) for k, v in held.items() if k.startswith("partition.")]

    def set_partition(self, name: str, part: str, bounds: tuple[str | None, str | None] | None) -> None:
        t = self.table(name)
        key = f"partition.{part}"
        if (bounds is None) != (key in t.properties):
            raise ValueError(f"there is {'no' if bounds is None else 'a'} partition {part}")
        if bounds is None:
            del t.properties[key]
        else:
            t.properties[key] = json.dumps(bounds)
        self._put(name, t)

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(self.table(name).schema)

    # ---- rows

    def df(self, name: str) -> DataFrame:
        t = self.table(name)
        schema = StructType.fromDDL(t.schema)
        if not t.parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType.fromDDL(f"{t.schema}, {AT} {AT_TYPE}") if t.keyed else schema).parquet(*[f"{self.root}/{p}" for p in t.parts])
        if t.model in ("unique", "primary"):
            return _latest(rows, t.keys, F.col(AT)).select(*schema.names)
        if t.model == "aggregate":
            return rows.groupBy(*t.keys).agg(*[MERGE[t.aggregates.get(c, "replace")](c).alias(c) for c in schema.names if c not in t.keys]).select(*schema.names)
        return rows

    def _write(self, name: str, df: DataFrame) -> str:
        db, t = self._split(name)
        part = f"{db}/{t}/{uuid.uuid4().hex}"
        self.state["statement"] = self.state.get("statement", 0) + 1
        if self.table(name).keyed:
            df = df.withColumn(AT, F.struct(F.lit(self.state["statement"]).cast("long").alias("statement"), F.monotonically_increasing_id().alias("place")))
        df.write.option("compression", "zstd").parquet(f"{self.root}/{part}")
        return part

    def _fitted(self, name: str, df: DataFrame, columns: list[str] | None) -> DataFrame:
        """By position, or with ``columns`` by these names; what is missing is null."""
        schema = self.schema(name)
        names = columns or schema.names[: len(df.columns)]
        if len(names) != len(df.columns):
            raise ValueError(f"{len(names)} columns and {len(df.columns)} values")
        df = df.toDF(*names)
        return df.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def insert(self, name: str, df: DataFrame, columns: list[str] | None = None) -> None:
        t = self.table(name)
        t.parts.append(self._write(name, self._fitted(name, df, columns)))
        self._put(name, t)

    def replace(self, name: str, df: DataFrame, schema: str | None = None, **changes) -> None:
        t = self.table(name)
        t.parts = [self._write(name, df)]
        t.schema = schema or t.schema
        for k, v in changes.items():
            setattr(t, k, v)
        self._put(name, t)

    def overwrite(self, name: str, df: DataFrame, columns: list[str] | None = None) -> None:
        self.replace(name, self._fitted(name, df, columns))

    def truncate(self, name: str) -> None:
        t = self.table(name)
        t.parts = []
        self._put(name, t)

    def _guarded(self, name: str) -> DataFrame:
        df = self.df(name)
        if self.most_rows is not None and (n := df.count()) > self.most_rows:
            raise ValueError(f"{name} has {n} rows, and no more than {self.most_rows} may be changed")
        return df

    def _hit(self, name: str, df: DataFrame, where: str | None) -> DataFrame:
        """``df`` with ``__hit``. The condition may use other tables in subqueries."""
        self.register()
        df.createOrReplaceTempView(self._split(name)[1])
        return self.spark.sql(f"SELECT *, coalesce({where or 'true'}, false) AS __hit FROM {self._split(name)[1]}")

    def update(self, name: str, sets: dict[str, str], where: str | None = None) -> None:
        """The expressions are applied one after another; a later one sees what earlier ones set."""
        df = self._hit(name, self._guarded(name), where)
        for c, e in sets.items():
            df = df.withColumn(c, F.when(F.col("__hit"), F.expr(e).cast(df.schema[c].dataType)).otherwise(F.col(c)))
        self.replace(name, df.drop("__hit"))

    def delete(self, name: str, where: str | None = None, order: list[Column] | None = None, limit: int | None = None) -> None:
        """With ``limit``, the first so many of the rows that the condition finds, in ``order``."""
        df = self._hit(name, self._guarded(name), where)
        if limit is None:
            return self.replace(name, df.filter(~F.col("__hit")).drop("__hit"))
        df = self.spark.read.parquet(f"{self.root}/{self._write(name, df.withColumn('__place', F.monotonically_increasing_id()))}")
        gone = df.filter("__hit").orderBy(*(order or []), "__place").limit(limit).select(F.col("__place").alias("__gone"))
        self.replace(name, df.join(gone, F.col("__place") == F.col("__gone"), "left_anti").select(*self.schema(name).names))

    def upsert(self, name: str, df: DataFrame, keys: list[str], sets: dict[str, str] | None = None) -> None:
        """Rows of ``df`` replace those of equal keys, or with ``sets`` change them (``new.c`` is the incoming value of a column, ``c`` or ``old.c`` the one that is there); the others are added."""
        schema = self.schema(name)
        new = _latest(self._fitted(name, df, df.columns), keys, F.monotonically_increasing_id()).select(F.struct(*schema.names).alias("new"))
        same = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
        both = self.df(name).select(F.struct(*schema.names).alias("old")).join(new, same, "full")
        both = both.select("old", "new", *[F.col(f"old.{c}").alias(c) for c in schema.names])

        def value(c: str) -> Column:
            changed = F.expr(sets[c]) if sets and c in sets else F.col(f"old.{c}") if sets else F.col(f"new.{c}")
            return F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(changed)

        self.replace(name, both.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in schema]))

    # ---- changes of shape

    def _reshaped(self, name: str, df: DataFrame) -> None:
        self.replace(name, df, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))

    def add_column(self, name: str, column: str, kind: str, default: str = "NULL") -> None:
        """Without a default no file is written: old files lack the column, and it reads as null."""
        if default == "NULL":
            t = self.table(name)
            t.schema += f", `{column}` {kind}"
            return self._put(name, t)
        self._reshaped(name, self.df(name).withColumn(column, F.expr(default).cast(kind)))

    def drop_column(self, name: str, column: str) -> None:
        self._reshaped(name, self.df(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        self._reshaped(name, self.df(name).withColumnRenamed(old, new))

    def modify_column(self, name: str, column: str, kind: str) -> None:
        self._reshaped(name, self.df(name).withColumn(column, F.col(column).cast(kind)))

    def rename(self, old: str, new: str) -> None:
        t = self.table(old)
        self._put(old, None)
        self._put(new, t)

    def swap(self, a: str, b: str) -> None:
        x, y = self.table(a), self.table(b)
        self._put(a, y)
        self._put(b, x)

    def analyze(self, name: str, rows: list[dict]) -> None:
        """Keeps statistics, a few numbers for each column."""
        t = self.table(name)
        t.stats = rows
        self._put(name, t)

    def describe_as(self, name: str, comment: str | None = None, **properties: str) -> None:
        t = self.table(name)
        t.comment = t.comment if comment is None else comment
        t.properties |= properties
        self._put(name, t)

    # ---- transactions

    def begin(self) -> None:
        """Inside a transaction it opens an inner one."""
        self.saved.append(("", json.dumps(self.state)))

    def savepoint(self, name: str) -> None:
        if not self.saved:
            self.begin()
        self.saved.append((name.lower(), json.dumps(self.state)))

    def _savepoint(self, name: str) -> int:
        at = next((k for k in range(len(self.saved) - 1, -1, -1) if self.saved[k][0] == name.lower()), None)
        if at is None:
            raise KeyError(f"there is no savepoint {name}")
        return at

    def release(self, name: str) -> None:
        del self.saved[self._savepoint(name) :]

    def _end(self) -> str:
        """The state at the transaction's start; its savepoints go."""
        while self.saved and self.saved[-1][0]:
            self.saved.pop()
        if not self.saved:
            raise ValueError("there is no transaction")
        return self.saved.pop()[1]

    def commit(self) -> None:
        self._end()
        self._save()

    def rollback(self, to: str | None = None) -> None:
        """``to`` a savepoint, which stays, or to the start. Numbers of statements are never used again."""
        at = self.state.get("statement", 0)
        if to is not None:
            k = self._savepoint(to)
            del self.saved[k + 1 :]
            self.state = json.loads(self.saved[k][1])
        else:
            self.state = json.loads(self._end())
        self.state["statement"] = at
        self._save()

    def vacuum(self) -> int:
        """Removes folders that no table names, nor any that a rollback may bring back, nor an upload; how many. No other writer may be at work."""
        states = [self.state, *(json.loads(x) for _, x in self.saved)]
        if self.saved:  # what the files say is what others read until the commit
            states.append(json.loads(self.files.read(CATALOG.format(self.version))))
        named = {p for s in states for db in s["databases"].values() for t in db.values() for p in t["parts"]}
        folders = [x for x in self.files.names() if not x.startswith(".") and not x.startswith("catalog-")]
        gone = [p for db in folders for t in self.files.names(db) for x in self.files.names(f"{db}/{t}") if (p := f"{db}/{t}/{x}") not in named]
        for p in gone:
            self.files.delete(p)
        return len(gone)

    # ---- copies

    def export(self, name: str, path: str, form: str) -> None:
        export(self.df(name), path, form)

    def load(self, name: str, path: str, form: str) -> None:
        self.insert(name, imported(self.spark, path, form, self.schema(name) if form == "csv" else None))

    def backup(self, database: str, to: str) -> dict[str, int]:
        """Copies every table of a database below ``to``; their row counts."""
        folder, out, held = Folder(self.spark, to), {}, {}
        for t in self.tables(database):
            df = self.df(f"{database}.{t}")
            df.write.mode("overwrite").parquet(f"{to}/{t}")
            out[t] = self.spark.read.parquet(f"{to}/{t}").count()
            held[t] = asdict(self.table(f"{database}.{t}"))
        folder.delete("backup.json")  # of an earlier copy under this name
        folder.write("backup.json", json.dumps(held))
        return out

    def restore(self, database: str, path: str) -> None:
        self.create_database(database, if_missing=True)
        for t, kept in json.loads(Folder(self.spark, path).read("backup.json")).items():
            name = f"{database}.{t}"
            if t in self.tables(database):
                self.drop(name)
            self.create(name, **(kept | {"parts": []}))  # statistics come with it
            self.insert(name, self.spark.read.parquet(f"{path}/{t}"))


def _latest(df: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Of rows with equal keys the last one by ``place``."""
    names = df.columns
    rest = [c for c in names if c not in keys]
    if not rest:
        return df.distinct()
    out = df.withColumn("__place", place).groupBy(*keys).agg(F.max_by(F.struct(*rest), "__place").alias("__r"))
    return out.select(*[c if c in keys else F.col(f"__r.{c}").alias(c) for c in names])
