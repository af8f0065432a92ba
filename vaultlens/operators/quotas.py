"""Disk quotas: volumes and their sizes, snapshots over time, totals.

A snapshot has a place, a timestamp, the file system's space and an array of volumes; number -1 marks the
row of a whole host. strict: a missing size makes totals NaN; otherwise it counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def volume_sizes(subvolumes: DataFrame, hosts: DataFrame, qgroups: DataFrame, quotas: DataFrame) -> DataFrame:
    """SET-01, JN-01, JN-07: backups' volumes and hosts' groups with their sizes; quotas of neither are dropped.

    subvolumes (id, host, number), hosts (pos, host), qgroups (host, qgroup_id), quotas (id, refr, excl).
    """
    of_backups = subvolumes.filter("id >= 0").selectExpr("concat('0/', id) as key", "host", "number", "0 as kind", "id as place")
    of_hosts = hosts.join(qgroups, "host").filter("qgroup_id >= 0").selectExpr("concat('1/', qgroup_id) as key", "host", "-1L as number", "1 as kind", "cast(pos as bigint) as place")
    sizes = quotas.select(F.col("id").alias("key"), "refr", "excl")
    return of_backups.unionByName(of_hosts).join(sizes, "key", "left").select("host", "number", "refr", "excl", "kind", "place")


def snapshot(sizes: DataFrame, space: DataFrame, now_ms: int) -> DataFrame:
    """DML-03: the row to append: (timestamp, volumes, space). sizes: volume_sizes; space: one row."""
    entry = F.struct("kind", "place", F.struct("host", "number", "refr", "excl").alias("v"))
    volumes = sizes.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"]).alias("volumes"))
    return volumes.crossJoin(space.select(F.struct("fstype", "size", "used", "free").alias("space"))).select(F.lit(now_ms).cast("bigint").alias("timestamp"), "volumes", "space")


def appended(quotas: DataFrame, row: DataFrame) -> DataFrame:
    """DML-03: the series with one more snapshot."""
    place = quotas.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("int").alias("pos"))
    return quotas.unionByName(row.crossJoin(place))


def _of(host: str | None, whole: bool):
    # the empty name means no filter; a missing number is a backup's
    def keep(v: Column) -> Column:
        rollup = v["number"].eqNullSafe(F.lit(-1))
        kind = rollup if whole else ~rollup
        return kind if not host else kind & v["host"].eqNullSafe(F.lit(host))

    return keep


def volumes_of(volumes: Column, host: str | None = None) -> Column:
    """FLT-01, PRJ-05: a snapshot's volumes with total = refr + excl."""
    return F.transform(F.filter(volumes, _of(host, False)), lambda v: v.withField("total", v["refr"] + v["excl"]))


def hosts_of(volumes: Column, host: str | None = None) -> Column:
    """FLT-02, PRJ-06: a snapshot's hosts with total = refr."""
    return F.transform(F.filter(volumes, _of(host, True)), lambda v: v.withField("total", v["refr"]))


def total_of(volumes: Column, used: Column, strict: bool = False) -> Column:
    """AGG-01: struct of refr = used - sum of excl, excl and total = sum of both; none: (used, 0, 0)."""
    missing = F.lit(float("nan")) if strict else F.lit(0.0)
    size = lambda x: F.coalesce(x.cast("double"), missing)
    mine = F.filter(volumes, _of(None, False))
    add = lambda f: F.aggregate(mine, F.lit(0.0), lambda a, v: a + f(v))
    excl, total = add(lambda v: size(v["excl"])), add(lambda v: size(v["excl"]) + size(v["refr"]))
    kind = "double" if strict else "bigint"
    return F.struct((used.cast("double") - excl).cast(kind).alias("refr"), excl.cast(kind).alias("excl"), total.cast(kind).alias("total"))


def totals(quotas: DataFrame, strict: bool = False) -> DataFrame:
    """AGG-01, PRJ-15: shared, exclusive and cumulated size of each snapshot."""
    return quotas.select("pos", "timestamp", total_of(F.col("volumes"), F.col("space.used"), strict).alias("t")).select("pos", "timestamp", "t.refr", "t.excl", "t.total")


def current(quotas: DataFrame) -> DataFrame:
    """WIN-03: the last snapshot by place."""
    return quotas.orderBy(F.desc("pos")).limit(1)


def current_repartition(quotas: DataFrame) -> DataFrame:
    """PRJ-21: hosts of the last snapshot with total = refr; no snapshot: no rows."""
    return current(quotas).select(F.explode(hosts_of(F.col("volumes"))).alias("v")).select("v.host", "v.refr", "v.excl", "v.total")


def current_space(space: DataFrame, now_ms: int) -> DataFrame:
    """PRJ-07."""
    return space.withColumn("timestamp", F.lit(now_ms).cast("bigint"))
