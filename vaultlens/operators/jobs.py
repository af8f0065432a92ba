"""Queue jobs: states, counts, lookups, which hosts are due, which jobs go when one ends.

jobs: schemas.JOBS (id, name, state, timestamp, data.host, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import JOB_STATES, SCHEDULER_DEFAULTS


def in_states(jobs: DataFrame, states: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """SRC-21: jobs of the given states; none given: all."""
    return jobs.filter(F.col("state").isin(*states)) if states else jobs


def pending_data(jobs: DataFrame) -> DataFrame:
    """SRC-22: what jobs that aren't completed work on."""
    return in_states(jobs, ("waiting", "active", "failed", "delayed")).select("data.*")


def counts(jobs: DataFrame) -> DataFrame:
    """AGG-02: one row with a count for each state, 0 without jobs."""
    return jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in JOB_STATES])


def by_state(jobs: DataFrame) -> DataFrame:
    """AGG-03, AGG-10: ids and number of jobs of each state; a null state is left out."""
    return jobs.filter("state is not null").groupBy("state").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def latest_state(jobs: DataFrame) -> DataFrame:
    """WIN-04, SRT-02: state of each host's job with the greatest timestamp, whatever its name."""
    return jobs.select("data.host", "timestamp", "id", "state").filter("host is not null").groupBy("host").agg(F.max_by("state", F.struct("timestamp", "id")).alias("state"))


def to_enqueue(hosts: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-05: hosts without an active, delayed or waiting job, each once."""
    busy = in_states(jobs, ("active", "delayed", "waiting")).select("data.host")
    return hosts.join(busy, "host", "left_anti").dropDuplicates(["host"])


def with_live(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """JN-09: jobs with the state and progress that the queue has now."""
    return jobs.drop("state", "progress").join(live.select("id", "state", "progress"), "id", "left")


def normal_progress(jobs: DataFrame) -> DataFrame:
    """STR-09: progress in percent: stats jobs count to 1, backups to 100."""
    return jobs.withColumn("progress", F.when(F.col("name") == "stats", F.col("progress") * 100).otherwise(F.col("progress")))


def lock_active(locks: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-10: whether each host's lock is held by an active job. locks: host, locked_by (null: free)."""
    owner = jobs.select(F.col("id").alias("locked_by"), F.col("state").alias("owner_state"))
    return locks.join(owner, "locked_by", "left").select("host", F.coalesce(F.col("owner_state") == "active", F.lit(False)).alias("locked"))


def lock_text(locks: DataFrame) -> DataFrame:
    """FN-27: host and what its lock file holds: the job's id and name as JSON. locks: host, id, name."""
    return locks.select("host", F.to_json(F.struct("id", "name")).alias("content"))


def lock_content(texts: DataFrame) -> DataFrame:
    """FN-27: host, id, name of lock files' texts; null for text that isn't JSON."""
    return texts.select("host", F.from_json("content", "id bigint, name string").alias("c")).select("host", "c.id", "c.name")


def merged_schedule(configs: DataFrame, scheduler: DataFrame | None = None) -> DataFrame:
    """PRJ-18: each host's schedule over the default one, field by field; backupToKeep is taken whole."""
    default = SCHEDULER_DEFAULTS["defaultSchedule"]
    rows = configs.crossJoin(F.broadcast(scheduler.select(F.col("defaultSchedule").alias("d")).limit(1))) if scheduler is not None else configs.withColumn("d", F.from_json(F.lit(None).cast("string"), "activated boolean, backupPerdiod bigint"))
    pick = lambda f, v: F.coalesce(F.col(f"schedule.{f}"), *([F.col(f"d.{f}")] if scheduler is not None else []), *([F.lit(v)] if scheduler is None else []))
    return rows.select("host", pick("activated", default["activated"]).alias("activated"), pick("backupPerdiod", default["backupPerdiod"]).cast("bigint").alias("backupPerdiod"))


def due(schedules: DataFrame, last: DataFrame, now_ms: int) -> DataFrame:
    """FLT-06: whether a backup of each host is due: activated, and the last is incomplete, older than the period or missing."""
    joined = schedules.join(last.select("host", "complete", "startDate"), "host", "left")
    age = (F.lit(now_ms) - F.coalesce("startDate", F.lit(0))) / 1000.0
    is_due = F.coalesce("activated", F.lit(False)) & (~F.coalesce("complete", F.lit(False)) | F.coalesce(age > F.col("backupPerdiod"), F.lit(False)))
    return joined.select("host", is_due.alias("due"))


def cancelled_by(jobs: DataFrame, ended_id: int) -> DataFrame:
    """FLT-10: backup and stats jobs of an ended job's host that go with it: not itself, not active."""
    ended = jobs.filter(F.col("id") == ended_id).select(F.col("data.host").alias("of"))
    mine = jobs.filter(F.col("name").isin("backup", "stats") & (F.col("id") != ended_id) & (F.coalesce("state", F.lit("")) != "active") & (F.coalesce("data.host", F.lit("")) != ""))
    return mine.join(ended, F.col("data.host") == F.col("of"), "left_semi")


def without_cancelled(jobs: DataFrame, ended_id: int) -> DataFrame:
    """DML-07."""
    return jobs.join(cancelled_by(jobs, ended_id).select("id"), "id", "left_anti")


def removable(jobs: DataFrame) -> DataFrame:
    """FLT-15: remove jobs need a host and a number."""
    return jobs.filter("data.host is not null and data.host <> '' and data.number is not null")


def enqueued(hosts: DataFrame, name: str, first_id: int, now_ms: int) -> DataFrame:
    """SNK-05: the rows to append for jobs over hosts (host, and number for remove jobs), in host order."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy("host")) - 1
    number = F.col("number") if "number" in hosts.columns else F.lit(None).cast("bigint")
    return hosts.select((F.lit(first_id) + place).alias("id"), F.lit(name).alias("name"), F.lit("waiting").alias("state"), F.lit(now_ms).cast("bigint").alias("timestamp"), F.struct("host", number.alias("number")).alias("data"))
