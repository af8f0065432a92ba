"""Log texts: whole, as a stream, and written by day and level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text


def read(spark: SparkSession, path: str) -> DataFrame:
    """SRC-23."""
    return spark.read.text(path)


def tail(spark: SparkSession, path: str) -> DataFrame:
    """SRC-24, STR-08: lines of a folder's files from the first on, and those that come."""
    return spark.readStream.text(path)


def write(entries: DataFrame, path: str) -> None:
    """SNK-03: formatted lines in a folder for each day. entries: ts, level, context, message."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = text.log_line(stamp, F.col("level"), F.col("context"), F.col("message"))
    entries.select(line.alias("value"), F.to_date("ts").cast("string").alias("day")).write.mode("append").partitionBy("day").text(path)


def write_backup(entries: DataFrame, path: str) -> None:
    """SNK-04, FLT-13: a backup's log, and its errors once more."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    lines = entries.select("level", text.backup_log_line(stamp, F.col("level"), F.col("message")).alias("value"))
    lines.select("value").write.mode("append").text(f"{path}/log")
    lines.filter("level = 'error'").select("value").write.mode("append").text(f"{path}/error.log")
