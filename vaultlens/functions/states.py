"""States of tasks, jobs and hosts: rules, colours, icons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def task_state(subtasks: Column) -> Column:
    """AGG-05: state of a task from its subtasks' states; none at all is success."""
    any_ = lambda *states: F.exists(subtasks, lambda s: s["state"].isin(*states))
    open_, bad = any_("RUNNING", "WAITING"), any_("FAILED", "ABORTED")
    return (
        F.when(open_ & bad, "ABORTED").when(open_ & any_("RUNNING"), "RUNNING").when(open_, "WAITING").when(bad, "FAILED").otherwise("SUCCESS")
    )


def complete(subtasks: Column) -> Column:
    """AGG-07."""
    return task_state(subtasks) == "SUCCESS"


def state_colour(state: Column) -> Column:
    """FN-17: colour of a host's state."""
    return F.when(state.isin("waiting", "active"), "blue").when(state == "failed", "red").when(state == "completed", "green").when(state == "delayed", "yellow")


def job_colour(state: Column) -> Column:
    """FN-17: colour of a group of jobs."""
    return F.when(state == "active", "primary").when(state == "completed", "green").when(state == "failed", "red").when(state.isin("waiting", "delayed"), "yellow").otherwise("secondary")


def subtask_icon(state: Column, job_state: Column) -> Column:
    """FN-30: a subtask that runs in a job that doesn't has failed."""
    active = job_state == "active"
    return (
        F.when(state == "SUCCESS", "mdi-checkbox-marked-circle-outline")
        .when(state == "WAITING", "mdi-clock-outline")
        .when((state == "RUNNING") & active, "progress")
        .when((state == "FAILED") | (state == "RUNNING"), "mdi-alert-circle-outline")
        .when(state == "ABORTED", "mdi-cancel")
    )


def running(job_state: Column) -> Column:
    """FN-25."""
    return job_state == "active"


def failed(job_state: Column) -> Column:
    return job_state == "failed"


def host_state(job_state: Column, complete_: Column) -> Column:
    """PRJ-10: the job's state, else failed or idle by the last backup, else null. complete_: null without a backup."""
    return F.coalesce(F.nullif(job_state, F.lit("")), F.when(~complete_, "failed").when(complete_, "idle"))


def operation_kind(op: Column) -> Column:
    """FN-28: the variant that an operation shows as, by the field that it holds (its name decides what runs)."""
    held = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return F.when(held(op["command"]), "ExecuteCommandOperation").when(op["authentification"], "RSyncdBackupOperation").when(op["share"].isNotNull(), "RSyncBackupOperation")


def copy_succeeded(code: Column) -> Column:
    """FLT-16: exit code 24 (files that vanished meanwhile) counts as success; null is no error."""
    return F.coalesce(code, F.lit(0)).isin(0, 24)


def check_valid(name: Column, output: Column, code: Column) -> Column:
    """FLT-17: validity of a self-check by its name."""
    return F.when(name == "getFilesystem", F.trim(output) == "btrfs").when(name.startswith("resolveNetbios"), code != 127).otherwise(F.coalesce(code, F.lit(0)) == 0)
