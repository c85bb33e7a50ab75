"""Small files and folders by Hadoop's file systems, so that any store Spark reads will do; and export and import."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "csv")


class Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).exists(p)

    def delete(self, name: str) -> None:
        p = self._path(name)
        self._fs(p).delete(p, True)

    def size(self, name: str) -> int:
        """The bytes of a folder."""
        p = self._path(name)
        return self._fs(p).getContentSummary(p).getLength()

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        return sorted(x.getPath().getName() for x in self._fs(p).listStatus(p)) if self._fs(p).exists(p) else []

    def write(self, name: str, text: str) -> None:
        """A new file, by a temporary one that is renamed, so that it is there as a whole or not at all. One that is there stays, and is an error."""
        p, new = self._path(name), self._path(f".{name}.{uuid.uuid4().hex}")
        fs = self._fs(p)
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(new, p):
            fs.delete(new, False)
            raise FileExistsError(f"{p} is there already")

    def read(self, name: str) -> str:
        p = self._path(name)
        stream = self._fs(p).open(p)
        out = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return out


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which goes at the end of the application; on a single machine it may be a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
    out = Folder(spark, f"{shared.rstrip('/')}/tidemark/{uuid.uuid4().hex}")
    path = out._path("")
    out._fs(path).mkdirs(path)
    out._fs(path).deleteOnExit(path)
    return out.root


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` as written once."""
    path = f"{scratch(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export(df: DataFrame, path: str, form: str) -> None:
    """A folder of Parquet or of CSV with a header."""
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    w = df.write.mode("overwrite")
    w.parquet(path) if form == "parquet" else w.option("header", True).csv(path)


def imported(spark: SparkSession, path: str, form: str, schema: StructType | None = None) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path) if form == "parquet" else (r if schema is not None else r.option("inferSchema", True)).option("header", True).csv(path)
