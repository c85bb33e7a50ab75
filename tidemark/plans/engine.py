"""Statements as text: queries go to Spark after a rewrite of their dialect, all others change or describe a Lake."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register
from .dialects import DIALECTS, Masked
from .lake import Lake
from .schema_tables import TABLES, schema_table
from .scripts import Script
from .stats import column_stats
from .types import spark_type

NAME = r"`?([\w.]+)`?"
#: A string literal. Statements are matched with their literals masked, so that no word, comma or bracket in one is taken for a part of the statement.
TEXT = r"(\x00\d+\x00)"
#: Statements that are accepted for the sake of clients, change nothing and say so.
ACCEPTED = r"(?:set\s+(?:global|session|names)|kill|admin|recover|install|uninstall|create\s+(?:job|index|user|role|row\s+policy|sql_block_rule|catalog)|drop\s+(?:job|index|user|role|row\s+policy|sql_block_rule|catalog|stats)|alter\s+(?:user|stats)|grant|revoke|cancel|pause|resume|lock|unlock)\b"
STATS = ("column", "n", "nulls", "distinct", "low", "high")
STATS_SCHEMA = "`column` string, n long, nulls long, `distinct` long, low string, high string"
VARIABLES = {"autocommit": "1", "sql_mode": "ONLY_FULL_GROUP_BY", "time_zone": "UTC", "character_set_server": "utf8mb4", "max_allowed_packet": "16777216", "version_comment": "tidemark"}


def split_list(text: str) -> list[str]:
    """At commas outside parentheses, brackets and quotes."""
    held = Masked(text, comments=False)
    out, depth, at = [], 0, 0
    for i, c in enumerate(held.text):
        if c in "([<":
            depth += 1
        elif c in ")]>":
            depth -= 1
        elif c == "," and not depth:
            out.append(held.whole(held.text[at:i]).strip())
            at = i + 1
    return [*out, held.whole(held.text[at:]).strip()] if text.strip() else []


class Found:
    """The groups of a masked statement, with their literals again."""

    def __init__(self, match: re.Match, held: Masked) -> None:
        self.match, self.held = match, held

    def __getitem__(self, i: int) -> str | None:
        return self.held.whole(self.match[i]) if self.match[i] is not None else None

    def value(self, i: int, default: str = "") -> str:
        """What a literal stands for."""
        return self.held.value(self.match[i]) if self.match[i] else default

    def parts(self, i: int) -> tuple[str, str]:
        """A group up to the bracket that closes it, and the rest."""
        text, depth, end = self.match[i], 1, 0
        while depth:
            if end == len(text):
                raise ValueError("a bracket isn't closed")
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        return self.held.whole(text[: end - 1]), self.held.whole(text[end:])


def properties(text: str) -> dict[str, str]:
    """``"a" = "b"`` pairs."""
    return {k[1:-1]: v[1:-1] for k, v in re.findall(r"""("[^"]*"|'[^']*')\s*=\s*("[^"]*"|'[^']*')""", text)}


class Engine:
    def __init__(self, spark: SparkSession, root: str, dialect: str = "doris", most_rows: int | None = None) -> None:
        self.spark, self.lake, self.dialect = spark, Lake(spark, root, most_rows), DIALECTS[dialect]
        register(spark)
        self.variables = dict(VARIABLES)
        self.statements: list[tuple[re.Pattern, Callable[[Found], DataFrame | None]]] = [(re.compile(p + r"\s*;?\s*$", re.I | re.S), f) for p, f in self._statements()]

    def sql(self, text: str) -> DataFrame:
        """The rows of a query, or what a statement has to say (status if nothing)."""
        held = Masked(text)
        plain = held.text.strip()
        for pattern, f in self.statements:
            if m := pattern.match(plain):
                out = f(Found(m, held))
                return out if out is not None else self._rows([("ok",)], "status string")
        if re.match(r"(?:select|with|values|from)\b|\(", plain, re.I):
            return self.query(held.whole(plain))
        raise ValueError(f"no such statement: {text[:80]}")

    def query(self, text: str) -> DataFrame:
        """A query may read ``information_schema``, too."""
        self.lake.register()
        held = Masked(text)
        for what in TABLES:
            view = f"information_schema_{what}"
            held.text, n = re.subn(rf"\binformation_schema\s*\.\s*{what}\b", view, held.text, flags=re.I)
            if n:
                self.information_schema(what).createOrReplaceTempView(view)
        return self.spark.sql(self.dialect(held.whole(held.text)).rstrip().rstrip(";"))

    def _explain(self, m: Found) -> DataFrame:
        self.lake.register()
        return self.spark.sql(f"EXPLAIN {(m[1] or '').upper()} {self.dialect(m[2])}")

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _statements(self):
        L = self.lake
        return [
            (rf"create\s+(?:database|schema)\s+(if\s+not\s+exists\s+)?{NAME}", lambda m: L.create_database(m[2], bool(m[1]))),
            (rf"drop\s+(?:database|schema)\s+(?:if\s+exists\s+)?{NAME}", lambda m: L.drop_database(m[1])),
            (rf"use\s+{NAME}", self._use),
            (rf"create\s+table\s+(if\s+not\s+exists\s+)?{NAME}\s+as\s+(.+)", self._create_as),
            (rf"create\s+table\s+(if\s+not\s+exists\s+)?{NAME}\s*\((.+)", self._create),
            (rf"drop\s+table\s+(if\s+exists\s+)?{NAME}", lambda m: None if m[1] and m[2] not in L.tables() else L.drop(m[2])),
            (rf"create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+{NAME}\s+as\s+(.+)", lambda m: self._view(m[1], m[2])),
            (rf"drop\s+(?:materialized\s+)?view\s+(?:if\s+exists\s+)?{NAME}", lambda m: self._view(m[1], None)),
            (rf"refresh\s+materialized\s+view\s+{NAME}", lambda m: None),
            (rf"insert\s+overwrite\s+(?:table\s+)?{NAME}\s*(.+)", lambda m: L.overwrite(m[1], self.query(m[2]))),
            (rf"insert\s+into\s+{NAME}\s+set\s+(.+?)(?:\s+on\s+duplicate\s+key\s+update\s+(.+))?", self._insert_set),
            (rf"insert\s+into\s+(?:table\s+)?{NAME}\s*(?:\(([^()]*)\)\s*)?((?:values|select|with|\().+?)(?:\s+on\s+duplicate\s+key\s+update\s+(.+))?", self._insert),
            (rf"replace\s+into\s+{NAME}\s*(?:\(([^()]*)\)\s*)?(.+)", lambda m: self._upsert(m[1], m[2], m[3], None)),
            (rf"update\s+{NAME}\s+set\s+(.+?)(?:\s+where\s+(.+))?", lambda m: L.update(m[1], self._sets(m[2]), m[3])),
            (rf"delete\s+from\s+{NAME}(?:\s+where\s+(.+?))?(?:\s+order\s+by\s+(.+?))?(?:\s+limit\s+(\d+))?", self._delete),
            (rf"truncate\s+table\s+(?:if\s+exists\s+)?{NAME}", lambda m: L.truncate(m[1])),
            (rf"merge\s+into\s+{NAME}(?:\s+(?:as\s+)?(?!using\b)(\w+))?\s+using\s+{NAME}(?:\s+(?:as\s+)?(?!on\b)(\w+))?\s+on\s+(.+?)\s+when\s+matched\s+then\s+update\s+set\s+(.+?)(\s+when\s+not\s+matched\s+(?:by\s+target\s+)?then\s+insert\s+.+)?", self._merge),
            (rf"select\s+(.+?)\s+into\s+{NAME}\s+(from\s.+)", lambda m: self._create_from(m[2], f"SELECT {m[1]} {m[3]}")),
            (rf"create\s+(?:or\s+(?:replace|alter)\s+)?proc(?:edure)?\s+{NAME}\s*(?:\(([^()]*)\)|((?:\s*,?\s*@\w+\s+\w+)*))\s*(?:as\s+)?begin\s+(.+)\s+end", self._procedure),
            (rf"drop\s+proc(?:edure)?\s+(?:if\s+exists\s+)?{NAME}", lambda m: L.state.get("procedures", {}).pop(m[1], None) and L._save()),
            (rf"(?:exec(?:ute)?|call)\s+{NAME}\s*(.*)", self._call),
            (rf"alter\s+table\s+{NAME}\s+add\s+column\s+`?(\w+)`?\s+([\w(), ]+?)(?:\s+default\s+(.+?))?", lambda m: L.add_column(m[1], m[2], spark_type(m[3]), m[4] or "NULL")),
            (rf"alter\s+table\s+{NAME}\s+drop\s+column\s+`?(\w+)`?", lambda m: L.drop_column(m[1], m[2])),
            (rf"alter\s+table\s+{NAME}\s+rename\s+column\s+`?(\w+)`?\s+(?:to\s+)?`?(\w+)`?", lambda m: L.rename_column(m[1], m[2], m[3])),
            (rf"alter\s+table\s+{NAME}\s+modify\s+column\s+`?(\w+)`?\s+([\w(), ]+)", lambda m: L.modify_column(m[1], m[2], spark_type(m[3]))),
            (rf"alter\s+table\s+{NAME}\s+replace\s+with\s+table\s+{NAME}", lambda m: L.swap(m[1], m[2])),
            (rf"alter\s+table\s+{NAME}\s+rename\s+(?:to\s+)?{NAME}", lambda m: L.rename(m[1], m[2])),
            (rf"alter\s+table\s+{NAME}\s+(?:modify\s+)?comment\s+{TEXT}", lambda m: L.describe_as(m[1], comment=m.value(2))),
            (rf"alter\s+table\s+{NAME}\s+set\s*\((.+)\)", lambda m: L.describe_as(m[1], **properties(m[2]))),
            (rf"alter\s+table\s+{NAME}\s+add\s+partition\s+(?:if\s+not\s+exists\s+)?`?(\w+)`?\s*(.*)", lambda m: self._partition(m[1], m[2], m[3])),
            (rf"alter\s+table\s+{NAME}\s+drop\s+partition\s+(?:if\s+exists\s+)?`?(\w+)`?", lambda m: self._partition(m[1], m[2], None)),
            (rf"alter\s+table\s+{NAME}\s+((?:add|drop)\s+rollup\s+.+)", lambda m: L.describe_as(m[1], **{f"__{len(L.table(m[1]).properties)}": m[2]})),
            (rf"alter\s+(?:database|schema)\s+{NAME}\s+rename\s+(?:to\s+)?{NAME}", lambda m: L.rename_database(m[1], m[2])),
            (rf"alter\s+(?:database|schema)\s+{NAME}\s+set\s+(?:properties\s*)?\((.+)\)", lambda m: L.describe_database(m[1], **properties(m[2]))),
            (r"(?:begin|start\s+transaction)(?:\s+work)?", lambda m: L.begin()),
            (r"savepoint\s+`?(\w+)`?", lambda m: L.savepoint(m[1])),
            (r"release\s+savepoint\s+`?(\w+)`?", lambda m: L.release(m[1])),
            (r"rollback\s+(?:work\s+)?to\s+(?:savepoint\s+)?`?(\w+)`?", lambda m: L.rollback(m[1])),
            (r"commit(?:\s+work)?", lambda m: L.commit()),
            (r"rollback(?:\s+work)?", lambda m: L.rollback()),
            (rf"export\s+table\s+{NAME}\s+to\s+{TEXT}(?:\s+format\s+as\s+(\w+))?", lambda m: L.export(m[1], m.value(2), (m[3] or "parquet").lower())),
            (rf"import\s+table\s+{NAME}\s+from\s+{TEXT}(?:\s+format\s+as\s+(\w+))?", lambda m: L.load(m[1], m.value(2), (m[3] or "parquet").lower())),
            (rf"create\s+repository\s+{NAME}\s+.*?location\s+{TEXT}", self._repository),
            (rf"drop\s+repository\s+{NAME}", lambda m: L.state["repositories"].pop(m[1]) and None),
            (r"show\s+repositories", lambda m: self._rows(sorted(L.state["repositories"].items()), "name string, location string")),
            (rf"backup\s+database\s+(\w+)\s+to\s+(\w+)\s+as\s+(\w+)", lambda m: self._rows(sorted(L.backup(m[1], f"{L.state['repositories'][m[2]]}/{m[3]}").items()), "table_name string, n long")),
            (rf"restore\s+database\s+(\w+)\s+from\s+(\w+)\s+as\s+(\w+)", lambda m: L.restore(m[1], f"{L.state['repositories'][m[2]]}/{m[3]}")),
            (rf"show\s+(?:databases|schemas)(?:\s+like\s+{TEXT})?", lambda m: self._rows([(d,) for d in sorted(L.state["databases"])], "name string").filter(F.col("name").ilike(m.value(1, "%")))),
            (rf"show\s+(?:full\s+)?tables(?:\s+like\s+{TEXT})?", lambda m: self._rows([(t,) for t in L.tables()], "name string").filter(F.col("name").ilike(m.value(1, "%")))),
            (rf"(?:describe|desc|show\s+(?:full\s+)?columns\s+from)\s+{NAME}", lambda m: self._rows([(f.name, f.dataType.simpleString(), f.nullable) for f in L.schema(m[1])], "field string, type string, nullable boolean")),
            (rf"show\s+create\s+table\s+{NAME}", lambda m: self._rows([(m[1], f"CREATE TABLE {m[1]} ({L.table(m[1]).schema})")], "name string, statement string")),
            (rf"show\s+table\s+status(?:\s+from\s+{NAME})?", lambda m: self._rows([(t, *L.size(f"{m[1] or L.database}.{t}"), L.table(f"{m[1] or L.database}.{t}").comment) for t in L.tables(m[1])], "name string, n long, bytes long, comment string")),
            (rf"show\s+partitions\s+from\s+{NAME}", lambda m: self._rows(sorted(L.partitions(m[1])), "name string, low string, high string")),
            (rf"show\s+(?:index(?:es)?|keys)\s+from\s+{NAME}", lambda m: self._rows([(m[1], "PRIMARY", i + 1, c) for i, c in enumerate(L.table(m[1]).keys)], "table_name string, key_name string, seq_in_index int, column_name string")),
            (rf"show\s+(?:global\s+|session\s+)?variables(?:\s+like\s+{TEXT})?", lambda m: self._rows(sorted(self.variables.items()), "name string, value string").filter(F.col("name").ilike(m.value(1, "%")))),
            (rf"show\s+(?:global\s+|session\s+)?status(?:\s+like\s+{TEXT})?", lambda m: self._rows(sorted(self._status().items()), "name string, value string").filter(F.col("name").ilike(m.value(1, "%")))),
            (rf"show\s+functions(?:\s+like\s+{TEXT})?", lambda m: self.spark.sql("SHOW FUNCTIONS").select(F.col("function").alias("name")).filter(F.col("name").ilike(m.value(1, "%")))),
            (r"show\s+engines", lambda m: self._rows([("parquet", "DEFAULT")], "name string, support string")),
            (r"show\s+(?:charset|character\s+set)", lambda m: self._rows([("utf8mb4", "utf8mb4_bin", 4)], "name string, collation string, bytes int")),
            (rf"show\s+(?:column\s+|table\s+)?stats\s+{NAME}", lambda m: self._rows([tuple(x[c] for c in STATS) for x in L.table(m[1]).stats], STATS_SCHEMA)),
            (r"show\s+(?:processlist|collation|backends|frontends|warnings|errors|plugins|analyze)\b.*", lambda m: self._rows([], "name string, value string")),
            (rf"set\s+(?:session\s+|global\s+|@@)?(\w+)\s*=\s*(?:{TEXT}|(\S+))", lambda m: self.variables.__setitem__(m[1].lower(), m.value(2) if m[2] else m[3])),
            (rf"analyze\s+table\s+{NAME}.*", self._analyze),
            (rf"drop\s+stats\s+{NAME}", lambda m: L.analyze(m[1], [])),
            (r"explain\s+(?:(extended|formatted|cost|codegen)\s+)?((?:select|with|values|\().+)", self._explain),
            (r"create\s+(?:temporary\s+)?function\s+(\w+)\s*\(([^()]*)\)\s+returns\s+([\w(),]+)\s+(?:return|as)\s+(.+)", lambda m: self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m[1]}({m[2]}) RETURNS {spark_type(m[3])} RETURN {m[4]}") and None),
            (r"drop\s+function\s+(?:if\s+exists\s+)?(\w+)", lambda m: self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {m[1]}") and None),
            (rf"{ACCEPTED}.*", lambda m: self._rows([("ignored",)], "status string")),
        ]

    def _status(self) -> dict[str, str]:
        tables = [t for ts in self.lake.state["databases"].values() for t in ts.values()]
        return {"Databases": str(len(self.lake.state["databases"])), "Tables": str(len(tables)), "Views": str(len(self.lake.state["views"])), "Statements": str(self.lake.state.get("statement", 0)), "Parts": str(sum(len(t["parts"]) for t in tables)), "Open_transactions": str(sum(not n for n, _ in self.lake.saved))}

    def _analyze(self, m: Found) -> DataFrame:
        """A row for each column, which is kept with the table."""
        rows = [r.asDict() for r in column_stats(self.lake.df(m[1])).collect()]
        self.lake.analyze(m[1], rows)
        return self._rows([tuple(x[c] for c in STATS) for x in rows], STATS_SCHEMA)

    def _partition(self, name: str, part: str, bounds: str | None) -> None:
        """Partitions by range are names for rows; Parquet's own statistics prune what a query doesn't need."""
        if bounds is None:
            return self.lake.set_partition(name, part, None)
        edges = [x.strip(" '\"") for x in re.findall(r"\(([^()]*)\)", bounds)]
        low, high = (None, edges[0]) if len(edges) == 1 else edges[:2] if edges else (None, None)
        self.lake.set_partition(name, part, (low, high))

    def _use(self, m: Found) -> None:
        if m[1] not in self.lake.state["databases"]:
            raise KeyError(m[1])
        self.lake.database = m[1]

    def _create(self, m: Found) -> None:
        if m[1] and m[2] in self.lake.tables():
            return
        columns, aggregates, keys = [], {}, []
        body, tail = m.parts(3)
        for x in split_list(body):
            if k := re.match(r"(?:primary|unique)\s+key\s*\(([^)]*)\)", x, re.I):
                keys = [c.strip(" `") for c in k[1].split(",")]
            elif c := re.match(r"`?(\w+)`?\s+(\w+(?:\s*\([\d, ]+\))?(?:\s*<.*>)?)(?:\s+(sum|min|max|replace)\b)?", x, re.I):
                columns.append(f"`{c[1]}` {spark_type(c[2])}")
                if c[3]:
                    aggregates[c[1]] = c[3].lower()
                if re.search(r"\bprimary\s+key\b", x, re.I):
                    keys = [c[1]]
        model = "primary" if keys else "duplicate"
        if k := re.search(r"\b(duplicate|aggregate|unique|primary)\s+key\s*\(([^)]*)\)", tail, re.I):
            model, keys = k[1].lower(), [c.strip(" `") for c in k[2].split(",")]
        held = properties(tail)
        for word, pattern in (("__partition", r"partition(?:ed)?\s+by[^()]*\(([^)]*)\)"), ("__distribution", r"distributed\s+by\s+hash\s*\(([^)]*)\)")):
            if p := re.search(pattern, tail, re.I):
                held[word] = p[1]
        note = re.search(r"\bcomment\s+'(.*?)'", tail, re.I)
        self.lake.create(m[2], ", ".join(columns), model=model, keys=keys, aggregates=aggregates, properties=held, comment=note[1] if note else "")

    def _create_as(self, m: Found) -> None:
        if not (m[1] and m[2] in self.lake.tables()):
            self._create_from(m[2], m[3])

    def _view(self, name: str, text: str | None) -> None:
        if text is None:
            self.lake.state["views"].pop(name, None)
        else:
            self.lake.state["views"][name] = self.dialect(text)
        self.lake._save()

    def _sets(self, text: str) -> dict[str, str]:
        out = {}
        for x in split_list(text):
            c, _, e = x.partition("=")
            out[c.strip(" `").split(".")[-1]] = self.dialect(e.strip())
        return out

    def _values(self, columns: str | None, text: str) -> tuple[DataFrame, list[str] | None]:
        names = [c.strip(" `") for c in columns.split(",")] if columns else None
        return self.query(f"SELECT * FROM {text}" if re.match(r"values\b", text, re.I) else text), names

    def _insert(self, m: Found) -> None:
        if m[4] or self.lake.table(m[1]).model in ("primary", "unique") and m[4] is not None:
            return self._upsert(m[1], m[2], m[3], m[4])
        self.lake.insert(m[1], *self._values(m[2], m[3]))

    def _insert_set(self, m: Found) -> None:
        sets = self._sets(m[2])
        text = "SELECT " + ", ".join(sets.values())
        if m[3]:
            return self._upsert(m[1], ",".join(sets), text, m[3])
        self.lake.insert(m[1], self.query(text), list(sets))

    def _upsert(self, name: str, columns: str | None, text: str, sets: str | None) -> None:
        df, names = self._values(columns, text)
        t = self.lake.table(name)
        fitted = df.toDF(*(names or self.lake.schema(name).names[: len(df.columns)]))
        changes = {c: re.sub(r"\bvalues\s*\(\s*`?(\w+)`?\s*\)", r"new.\1", e, flags=re.I) for c, e in self._sets(sets).items()} if sets else None
        self.lake.upsert(name, fitted, t.keys or self.lake.schema(name).names[:1], changes)

    def _delete(self, m: Found) -> None:
        order = []
        for x in split_list(m[3] or ""):
            e, down = re.subn(r"\s+desc$", "", re.sub(r"\s+asc$", "", x, flags=re.I), flags=re.I)
            order.append(F.expr(e).desc_nulls_last() if down else F.expr(e).asc_nulls_last())
        self.lake.delete(m[1], m[2], order, int(m[4]) if m[4] else None)

    def _merge(self, m: Found) -> None:
        """Without the part for rows that don't match, these are left out."""
        old, new = {m[1], m[2] or m[1]}, {m[3], m[4] or m[3]}
        names = lambda of: "|".join(map(re.escape, of))
        pairs = re.findall(r"(\w+)\.`?(\w+)`?\s*=\s*(\w+)\.`?(\w+)`?", m[5])
        keys = {(a if x in old else b): (b if x in old else a) for x, a, _, b in pairs}
        sets = {c: re.sub(rf"\b(?:{names(old)})\.", "old.", re.sub(rf"\b(?:{names(new)})\.", "new.", e)) for c, e in self._sets(m[6]).items()}
        df = self.lake.df(m[3]).withColumnsRenamed({b: a for a, b in keys.items() if a != b})
        if not m[7]:
            df = df.join(self.lake.df(m[1]).select(*keys).distinct(), list(keys), "left_semi")
        columns = [c for c in self.lake.schema(m[1]).names if c in df.columns]
        self.lake.upsert(m[1], df.select(*columns), list(keys), sets)

    def _create_from(self, name: str, text: str) -> None:
        df = self.query(text)
        self.lake.create(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
        self.lake.insert(name, df)

    def script(self, text: str, variables: dict | None = None) -> DataFrame | None:
        return Script(self, text, variables).run()

    def _procedure(self, m: Found) -> None:
        names = re.findall(r"(@?\w+)\s+\w+(?:\([\d, ]+\))?\s*(?:,|$)", re.sub(r"\b(?:in|out|inout)\s+", "", m[2] or m[3] or "", flags=re.I))
        self.lake.state.setdefault("procedures", {})[m[1]] = {"names": ["@" + n.lstrip("@").lower() for n in names], "text": m[4]}
        self.lake._save()

    def _call(self, m: Found) -> DataFrame | None:
        """With values in order, in brackets or not, or as ``@name = value``."""
        held = self.lake.state.get("procedures", {}).get(m[1])
        if held is None:
            raise KeyError(f"there is no procedure {m[1]}")
        given = dict.fromkeys(held["names"])
        for k, x in enumerate(split_list(re.sub(r"^\((.*)\)$", r"\1", m[2].strip(), flags=re.S))):
            named = re.match(r"(@\w+)\s*=\s*(.+)", x, re.S)
            name, text = (named[1].lower(), named[2]) if named else (held["names"][k], x)
            given[name] = self.query(f"SELECT {text} AS x").first()["x"]
        return self.script(held["text"], given)

    def _repository(self, m: Found) -> None:
        self.lake.state["repositories"][m[1]] = m.value(2)
        self.lake._save()

    def information_schema(self, what: str) -> DataFrame:
        return schema_table(self.spark, self.lake, what)
