"""The catalogue's own files as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from .yaml_source import YamlSource


def _read(spark: SparkSession, path: str, schema: str, rows: bool = False, default=None) -> DataFrame:
    spark.dataSource.register(YamlSource)
    reader = spark.read.format("vault_yaml").schema(schema).option("list", str(rows).lower())
    return (reader.option("default", json.dumps(default)) if default is not None else reader).load(path)


def hosts(spark: SparkSession, config: str) -> DataFrame:
    """SRC-03: pos, host."""
    return _read(spark, f"{config}/hosts.yml", "pos int, host string", rows=True)


def host_config(spark: SparkSession, config: str, host: str) -> DataFrame:
    """SRC-04: a listed host's configuration with its name; raises for others."""
    from ..operators.backups import require_host

    require_host(hosts(spark, config), host)
    return _read(spark, f"{config}/{host}.yml", schemas.HOST_CONFIG, default={}).withColumn("host", F.lit(host))


def backups(spark: SparkSession, root: str, host: str = "*") -> DataFrame:
    """SRC-05: backups of a host, or of all."""
    return _read(spark, f"{root}/{host}/backup.yml", schemas.BACKUPS, rows=True)


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """SRC-06: snapshots with their place."""
    volumes = "array<struct<host: string, number: bigint, refr: bigint, excl: bigint>>"
    whole = _read(spark, f"{root}/statistics.yml", f"quotas array<struct<timestamp: bigint, volumes: {volumes}, space: {schemas.SPACE}>>", default={"quotas": []})
    return whole.selectExpr("posexplode(quotas) as (pos, q)").select("pos", "q.*")


def scheduler(spark: SparkSession, config: str) -> DataFrame:
    """SRC-07: the scheduler's configuration; the defaults if the file is empty or missing (a partial file isn't completed)."""
    found = _read(spark, f"{config}/scheduler.yml", schemas.SCHEDULER, default=schemas.SCHEDULER_DEFAULTS)
    if not found.isEmpty():
        return found
    return spark.createDataFrame([(json.dumps(schemas.SCHEDULER_DEFAULTS),)], "j string").select(F.from_json("j", schemas.SCHEDULER).alias("s")).select("s.*")


def tools(spark: SparkSession, default: str, override: str) -> DataFrame:
    """SRC-08: tools, command, paths: the override's entries over the default's, section by section."""
    from ..functions.templates import overridden

    maps = "tools map<string,string>, command map<string,string>, paths map<string,string>"
    base, over = _read(spark, default, maps), _read(spark, override, maps)
    joined = base.join(over.select(*[F.col(c).alias(f"_{c}") for c in over.columns]), how="left", on=F.lit(True))
    return joined.select(*[overridden(F.col(c), F.col(f"_{c}")).alias(c) for c in base.columns])
