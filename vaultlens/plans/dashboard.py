"""What the dashboard shows, from the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cron
from ..operators import backups as b, jobs as j, quotas as q
from ..schemas import SCHEDULER_DEFAULTS


def queue(jobs: DataFrame, now_ms: int, rule: str = SCHEDULER_DEFAULTS["wakeupSchedule"]) -> DataFrame:
    """AGG-02, FN-20: counts by state with the last and the next wake-up."""
    now = F.lit(now_ms).cast("bigint")
    return j.counts(jobs).withColumns({"lastExecution": cron.previous_run(F.lit(rule), now), "nextWakeup": cron.next_run(F.lit(rule), now)})


def disk_usage(hosts: DataFrame, backups: DataFrame, quotas: DataFrame) -> dict[str, DataFrame]:
    """PRJ-12 to PRJ-16: series of sizes, hosts' shares of the last snapshot, compression over time."""
    return {"quotas": q.totals(quotas), "current": q.current(quotas), "repartition": q.current_repartition(quotas), "compression": b.compression_history(hosts, backups)}


def hosts_table(hosts: DataFrame, backups: DataFrame, jobs: DataFrame, now_ms: int) -> DataFrame:
    return b.host_rows(hosts, backups, j.latest_state(jobs), now_ms)
