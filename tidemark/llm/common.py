"""What the operators share: the shared folder, and splitting texts into bounded pieces."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as all operators here understand it.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()
#: Rows that a Python worker gets at once; the default of 10,000 long texts would be too much memory.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Once for each application: sends this package to the executors, whose Python workers unpickle functions of it by name.

    Batches for Python are made smaller, unless the session has a size of its own.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as into:
            for p in root.rglob("*.py"):
                to = Path(into, root.name, p.relative_to(root))
                to.parent.mkdir(parents=True, exist_ok=True)
                shutil.copyfile(p, to)
            out = tempfile.mkdtemp(prefix="tidemark-code-")
            spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/{root.name}", "zip", into))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (as in tests) one of our own, which a cluster's executors wouldn't see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and a lost executor costs no recomputation.

    What ``discard`` doesn't remove, as a result may still need it, goes at the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _fs(spark, path)[0].deleteOnExit(_fs(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing will read again, and lets Spark find the shuffles that nothing refers to."""
    for df in tables:
        fs, path = _fs(df.sparkSession, df._written_at)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def pieces(texts: Iterable[str | None], most: int, overlap: int = 0) -> Iterator[list[tuple[int, str]]]:
    """Lists of (index of the text, piece of it) of about ``most`` characters together.

    A longer text comes in several pieces, each of which repeats the last ``overlap`` characters of the one before.
    """
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        start = 0
        while True:
            piece = text[start : start + most] if start or len(text) > most else text
            if held and size + len(piece) > most:
                yield held
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
            start += len(piece)
            if start >= len(text):
                break
            start -= overlap
    if held:
        yield held
