"""The scheduler's two jobs as batch plans; now is an argument, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import backups as b, jobs as j, quotas as q


def due_hosts(hosts: DataFrame, configs: DataFrame, backups: DataFrame, jobs: DataFrame, now_ms: int, scheduler: DataFrame | None = None) -> DataFrame:
    """JN-05, PRJ-18, FLT-06: hosts without a pending job whose backup is due."""
    free = j.to_enqueue(hosts, jobs)
    schedules = j.merged_schedule(free.select("host").join(configs, "host", "left"), scheduler)
    return j.due(schedules, b.last_of_each(backups), now_ms).filter("due").select("host")


def nightly_snapshot(quotas: DataFrame, hosts: DataFrame, subvolumes: DataFrame, groups: DataFrame, sizes: DataFrame, space: DataFrame, now_ms: int) -> DataFrame:
    """SET-01, JN-01, DML-03: the statistics with tonight's snapshot."""
    return q.appended(quotas, q.snapshot(q.volume_sizes(subvolumes, hosts, groups, sizes), space, now_ms))
