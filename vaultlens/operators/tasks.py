"""Backup tasks: their ordered subtasks, progress, outcome, well-formedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers, states

__all__ = ["progression", "propagated", "states", "subtasks", "to_json", "well_formed", "imported_config"]


def progression(subtasks: Column, strict: bool = False) -> Column:
    """AGG-04, FLT-11: sums of the counters, mean percent and last speed other than 0 over subtasks that report.

    None reports: percent is null, or NaN in strict mode.
    """
    mine = F.filter(subtasks, lambda s: F.coalesce(s["progress"], F.lit(False)))
    total = lambda f, kind="bigint": F.aggregate(mine, F.lit(0).cast(kind), lambda a, s: a + F.coalesce(s["progression"][f].cast(kind), F.lit(0).cast(kind)))
    n = F.size(mine)
    speed = F.aggregate(mine, F.lit(0.0), lambda a, s: F.when(F.coalesce(s["progression"]["speed"], F.lit(0.0)) != 0, s["progression"]["speed"]).otherwise(a))
    fields = [total(f).alias(f) for f in ("fileSize", "newFileSize", "newFileCount", "fileCount")]
    return F.struct(*fields, speed.alias("speed"), numbers.ratio(total("percent", "double"), n, strict).alias("percent"))


def propagated(subtasks: Column) -> Column:
    """AGG-06, FLT-12, WIN-06: outcomes in order: after a failure, subtasks that may fail are aborted and the others still run.

    A subtask's own state is what it gives if it runs.
    """
    start = F.struct(F.lit(False).alias("failed"), F.slice(F.transform(subtasks, lambda s: s["state"]), 1, 0).alias("out"))

    def step(a: Column, s: Column) -> Column:
        state = F.when(a["failed"] & F.coalesce(s["failable"], F.lit(True)), F.lit("ABORTED")).otherwise(s["state"])
        return F.struct((a["failed"] | (state == "FAILED")).alias("failed"), F.concat(a["out"], F.array(state)).alias("out"))

    return F.aggregate(subtasks, start, step, lambda a: a["out"])


def subtasks(configs: DataFrame) -> DataFrame:
    """PRJ-22: host, pos, context, description, failable, progress of every step of a backup.

    configs: host and schemas.HOST_CONFIG. A storage step, the operations (one step for each share of a copy), the final
    operations, which run whatever failed, and a closing storage step.
    """
    command = "array(struct(o.command as context, concat('Execute command ', o.command) as description, {f} as failable, false as progress))"
    shares = "transform(coalesce(o.share, array()), s -> struct(s.name as context, concat('Execute backup for share ', s.name) as description, {f} as failable, true as progress))"
    each = "flatten(transform(coalesce(operations.{part}, array()), o -> case when o.name = 'ExecuteCommand' then " + command + " when o.name in ('RSyncBackup', 'RSyncdBackup') then " + shares + " else filter(" + command + ", x -> false) end))"
    ends = "array(struct('storage' as context, '{text}' as description, true as failable, false as progress))"
    steps = ", ".join([ends.format(text="Create the destination directory"), each.format(part="tasks", f="true"), each.format(part="finalizeTasks", f="false"), ends.format(text="Mark as readonly")])
    return configs.selectExpr("host", f"posexplode(concat({steps})) as (pos, step)").select("host", "pos", "step.*")


def copy_rules(configs: DataFrame) -> DataFrame:
    """SET-04, EXT-01: host, share, includes and excludes of each copy: the share's, then the operation's."""
    rows = configs.selectExpr("host", "explode(filter(operations.tasks, o -> o.name in ('RSyncBackup', 'RSyncdBackup'))) as o").selectExpr("host", "o", "explode(o.share) as s")
    join = lambda f: f"concat(coalesce(s.{f}, array()), coalesce(o.{f}, array()))"
    return rows.selectExpr("host", "s.name as share", f"{join('includes')} as includes", f"{join('excludes')} as excludes")


def to_json(tasks: DataFrame) -> DataFrame:
    """PRJ-01, PRJ-03: tasks with their state, progress and outcome as one JSON text."""
    rows = tasks.withColumns({"state": states.task_state(F.col("subtasks")), "complete": states.complete(F.col("subtasks")), "progression": progression(F.col("subtasks"))})
    kept = ["host", "number", "previousNumber", "ip", "startDate", "originalStartDate", "subtasks", "state", "progression", "complete"]
    return rows.select("host", "number", F.to_json(F.struct(*kept)).alias("json"))


def well_formed(tasks: DataFrame) -> DataFrame:
    """FLT-14: tasks with a configuration, a number, and an address unless local."""
    return tasks.filter("config is not null and number is not null and (coalesce(ip, '') <> '' or coalesce(config.isLocal, false))")


def imported_config(configs: DataFrame, prefix: str) -> DataFrame:
    """PRJ-17: configurations for an import: local, no commands, no final operations, copies over plain rsync from under a prefix."""
    prefixed = lambda s: s.withField("pathPrefix", F.lit(prefix))

    def one(o: Column) -> Column:
        plain = o.withField("share", F.transform(o["share"], prefixed))
        daemon = plain.withField("name", F.lit("RSyncBackup"))
        for f, kind in (("authentification", "boolean"), ("username", "string"), ("password", "string"), ("command", "string")):
            daemon = daemon.withField(f, F.lit(None).cast(kind))
        return F.when(o["name"] == "RSyncdBackup", daemon).when(o["name"] == "RSyncBackup", plain).otherwise(o)

    tasks = F.transform(F.filter(F.col("operations.tasks"), lambda o: o["name"] != "ExecuteCommand"), one)
    none = F.filter(F.coalesce(F.col("operations.finalizeTasks"), F.col("operations.tasks")), lambda o: F.lit(False))
    return configs.withColumn("operations", F.struct(tasks.alias("tasks"), none.alias("finalizeTasks"))).withColumn("isLocal", F.lit(True))
