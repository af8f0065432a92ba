"""DML-06, SET-03: the host list and configurations as tables with changes applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_host(hosts: DataFrame, host: str) -> DataFrame:
    """Hosts with one more behind, if it isn't there; ``hosts`` is no host's name."""
    if host == "hosts":
        raise ValueError("hosts is a reserved name")
    new = hosts.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("int").alias("pos"), F.coalesce(F.bool_or(F.col("host") == host), F.lit(False)).alias("there"))
    return hosts.unionByName(new.filter("not there").select("pos", F.lit(host).alias("host")))


def replaced(table: DataFrame, changes: DataFrame, key: str = "host") -> DataFrame:
    """Rows of a key replaced whole, others kept."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)
