"""Streams of events: the same functions take a batch or a stream. An extension of ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _watched(df: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which needs times with a zone (the session's, UTC)."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if df.isStreaming else df


def _local(name: str) -> Column:
    return F.col(f"w.{name}").cast("timestamp_ntz").alias(name)


def tumbling(df: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are dropped from a stream, and from a batch never."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _watched(df, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(_local("start"), _local("end"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    out = _watched(df, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", _local("start"), _local("end"), "n")


def first_seen(df: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, though it is sent several times."""
    return _watched(df, late).dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives the rows in memory; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
