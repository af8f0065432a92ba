"""Backups of hosts: lookups, last backups, running totals, mutations.

Tables: backups (schemas.BACKUPS; pos is a record's place in its host's list), hosts (pos, host).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import numbers


def of_host(backups: DataFrame, host: str) -> DataFrame:
    """SRC-05, PRJ-04: a host's backups in list order, with its name."""
    return backups.filter(F.col("host") == host).withColumn("hostname", F.col("host")).orderBy("pos")


def by_number(backups: DataFrame, host: str, number: int) -> DataFrame:
    """FLT-03, SRT-05: the first record of a number."""
    return backups.filter((F.col("host") == host) & (F.col("number") == number)).orderBy("pos").limit(1)


def last_of_each(backups: DataFrame) -> DataFrame:
    """WIN-02: each host's last record by place (not by number)."""
    whole = F.struct(*backups.columns)
    return backups.groupBy("host").agg(F.max_by(whole, "pos").alias("last")).select("last.*")


def next_numbers(hosts: DataFrame, backups: DataFrame) -> DataFrame:
    """WIN-05: the number of each host's next backup and the one that it starts from.

    After a complete backup n it is n + 1 from n; an incomplete one is done again from nothing; the first is 0.
    """
    last = last_of_each(backups).select("host", "number", "complete")
    return hosts.join(last, "host", "left").select(
        "host",
        F.when(F.col("complete"), F.col("number") + 1).otherwise(F.coalesce("number", F.lit(0))).alias("number"),
        F.when(F.col("complete"), F.col("number")).alias("previousNumber"),
    )


def with_last(hosts: DataFrame, backups: DataFrame) -> DataFrame:
    """JN-02, PRJ-20: hosts and their last backup, null without one."""
    last = last_of_each(backups)
    return hosts.join(last.select("host", F.struct(*last.columns).alias("lastBackup")), "host", "left")


def flattened(hosts: DataFrame, backups: DataFrame) -> DataFrame:
    """JN-03, SET-02: all backups in host order, then list order."""
    return hosts.select("host", F.col("pos").alias("host_pos")).join(backups, "host").orderBy("host_pos", "pos")


def with_config(hosts: DataFrame, configs: DataFrame) -> DataFrame:
    """JN-04."""
    return hosts.join(configs, "host", "left")


def known(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """JN-06, FLT-04: rows of listed hosts."""
    return rows.join(hosts.select("host"), "host", "left_semi")


def require_host(hosts: DataFrame, host: str) -> None:
    """FLT-04: raises for a host that isn't listed."""
    if hosts.filter(F.col("host") == host).isEmpty():
        raise LookupError(f"{host} is not a known host")


def subvolume_ids(wanted: DataFrame, subvolumes: DataFrame) -> DataFrame:
    """JN-08: wanted (host, number) with the id of the first subvolume of that host and number, by place; null without one.

    subvolumes: id, host, number, place.
    """
    first = subvolumes.groupBy("host", "number").agg(F.min_by("id", "place").alias("id"))
    return wanted.join(first, ["host", "number"], "left")


def duration(start: Column, end: Column) -> Column:
    """PRJ-08: null without an end (0 is none)."""
    return F.when(F.coalesce(end, F.lit(0)) != 0, end - start)


def size_split(backups: DataFrame) -> DataFrame:
    """PRJ-14: existing and new size of each backup, one row each."""
    return backups.selectExpr("host", "number", "stack(2, 'existing', coalesce(existingFileSize, 0L), 'new', coalesce(newFileSize, 0L)) as (part, size)")


def page(backups: DataFrame, page_no: int = 0, size: int = 10, by: str = "number", descending: bool = True) -> DataFrame:
    """SRT-03, SRT-04: a page of a sorted table."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return backups.orderBy(order, "pos").offset(page_no * size).limit(size)


def host_rows(hosts: DataFrame, backups: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """PRJ-09, PRJ-10: name, last number, age, size and state of every host."""
    from ..functions.states import host_state

    joined = with_last(hosts, backups).join(states.select("host", "state"), "host", "left")
    last = F.col("lastBackup")
    return joined.select(
        "host",
        last["number"].alias("lastBackupNumber"),
        (F.lit(now_ms) - last["startDate"]).alias("lastBackupAge"),
        last["fileSize"].alias("lastBackupSize"),
        host_state(F.col("state"), last["complete"]).alias("state"),
        F.col("pos"),
    ).orderBy("pos").drop("pos")


def compression_history(hosts: DataFrame, backups: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """WIN-01, SRT-01: running disk usage and uncompressed size over all backups by start; one row a backup.

    Ties go by host order, then list order. Totals are summed over chunks of time first; rows of a
    chunk then only add what came before their chunk, so no task sorts all backups. Missing sizes count 0.
    """
    usage = F.col("diskUsageStatistics")["total"]
    rows = hosts.select("host", F.col("pos").alias("host_pos")).join(backups, "host")
    rows = rows.select(
        F.col("startDate").alias("timestamp"), "host_pos", "pos", "host", "number",
        F.coalesce(usage["diskUsage"], F.lit(0)).alias("disk"), F.coalesce(usage["uncompressed"], F.lit(0)).alias("plain"),
    ).withColumn("chunk", F.floor(F.col("timestamp") / chunk_ms))
    sums = rows.groupBy("chunk").agg(F.sum("disk").alias("d"), F.sum("plain").alias("p"))
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("chunk", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"))
    inside = W.partitionBy("chunk").orderBy("timestamp", "host_pos", "pos").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.withColumn("di", F.sum("disk").over(inside)).withColumn("pi", F.sum("plain").over(inside))
    joined = joined.join(sums, "chunk")
    return joined.select("timestamp", "host", "number", (F.col("d") + F.col("di")).alias("diskUsage"), (F.col("p") + F.col("pi")).alias("uncompressed"), "host_pos", "pos")


def upserted(backups: DataFrame, changes: DataFrame) -> DataFrame:
    """DML-01, DML-04: each change replaces its number's first record in place, whole, or goes behind the host's list.

    changes: backups' columns without pos, at most one row for each host and number.
    """
    first = backups.groupBy("host", "number").agg(F.min("pos").alias("pos"))
    ends = backups.groupBy("host").agg(F.max("pos").alias("end"))
    placed = changes.join(first, ["host", "number"], "left").join(ends, "host", "left")
    new = F.row_number().over(W.partitionBy("host").orderBy(F.col("pos").isNotNull(), "number"))
    placed = placed.withColumn("pos", F.coalesce("pos", (F.coalesce("end", F.lit(-1)) + new).cast("int"))).select(backups.columns)
    return backups.join(placed.select("host", "pos"), ["host", "pos"], "left_anti").unionByName(placed)


def removed(backups: DataFrame, numbers_: DataFrame) -> DataFrame:
    """DML-02: without the first record of each (host, number)."""
    first = backups.join(numbers_.select("host", "number").distinct(), ["host", "number"]).groupBy("host", "number").agg(F.min("pos").alias("pos"))
    return backups.join(first.select("host", "pos"), ["host", "pos"], "left_anti")


def with_usage(backups: DataFrame, usage: DataFrame) -> DataFrame:
    """DML-04, DML-05: backups with new compression statistics (host, number, diskUsageStatistics) where there are some."""
    new = usage.select("host", "number", F.col("diskUsageStatistics").alias("_new"))
    return backups.join(new, ["host", "number"], "left").withColumn("diskUsageStatistics", F.coalesce("_new", "diskUsageStatistics")).select(backups.columns)


def stats_progress(backups: DataFrame, host: str) -> DataFrame:
    """DML-05: progress, from 0 to 1, after each backup of a host is done."""
    mine = backups.filter(F.col("host") == host)
    n = mine.agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("host").orderBy("pos"))
    return mine.withColumn("i", place).crossJoin(F.broadcast(n)).select("number", (F.col("i") / F.col("n")).alias("progress"))


def from_task(tasks: DataFrame, strict: bool = False) -> DataFrame:
    """PRJ-02, PRJ-03: backup records of tasks. now: end of the run, in ms.

    tasks: schemas.TASK with now. The end is set for complete tasks; an import keeps the original's start and the
    run's length. Speed is in bytes a millisecond.
    """
    from . import tasks as t

    rows = tasks.withColumn("p", t.progression(F.col("subtasks"), strict)).withColumn("complete", t.states.complete(F.col("subtasks")))
    shift = F.coalesce(F.col("originalStartDate") - F.col("startDate"), F.lit(0))
    return rows.select(
        "host", "number", "complete",
        F.coalesce("originalStartDate", "startDate").alias("startDate"),
        F.when(F.col("complete"), F.col("now") + shift).alias("endDate"),
        F.col("p.fileCount").alias("fileCount"), F.col("p.newFileCount").alias("newFileCount"), (F.col("p.fileCount") - F.col("p.newFileCount")).alias("existingFileCount"),
        F.col("p.fileSize").alias("fileSize"), (F.col("p.fileSize") - F.col("p.newFileSize")).alias("existingFileSize"), F.col("p.newFileSize").alias("newFileSize"),
        numbers.ratio(F.col("p.newFileSize"), F.col("now") - F.col("startDate"), strict).alias("speed"),
    )
