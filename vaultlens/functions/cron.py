"""FN-20: previous and next instant of a five-field cron rule (UTC).

Fields are numbers, ``*``, lists, ranges and steps; day of month and day of week
are alternatives when both are restricted. Instants are epoch milliseconds.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, functions as F

BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def fields(rule: str) -> list[set[int]]:
    found = []
    for text, (low, high) in zip(rule.split(), BOUNDS, strict=True):
        values: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b) if b else (high if step else int(a)))
            values.update(range(first, last + 1, int(step or 1)))
        found.append(values)
    found[4] = {d % 7 for d in found[4]}
    return found


def around(rule: str, ms: int, forward: bool) -> int | None:
    """The nearest instant strictly after (or before) ms, within eight years."""
    minutes, hours, days, months, weekdays = fields(rule)
    free = [text == "*" for text in rule.split()]
    sign = 1 if forward else -1
    at = datetime.fromtimestamp(ms // 60000 * 60, timezone.utc)
    if forward or ms % 60000 == 0:
        at += timedelta(minutes=sign)
    day, end = at.date(), at.date() + sign * timedelta(days=366 * 8)
    while day != end:
        in_month, in_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        fits = in_month and in_week if free[2] or free[4] else in_month or in_week
        if day.month in months and fits:
            times = sorted((h, m) for h in hours for m in minutes)
            for h, m in times if forward else reversed(times):
                found = datetime(day.year, day.month, day.day, h, m, tzinfo=timezone.utc)
                if (found >= at) if forward else (found <= at):
                    return int(found.timestamp() * 1000)
        day += timedelta(days=sign)
    return None


def _udf(forward: bool):
    @F.pandas_udf("bigint")
    def run(rule: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or pd.isna(m) else around(r, int(m), forward) for r, m in zip(rule, ms)], dtype="Int64")

    return run


def next_run(rule: Column, now_ms: Column) -> Column:
    return _udf(True)(rule, now_ms)


def previous_run(rule: Column, now_ms: Column) -> Column:
    return _udf(False)(rule, now_ms)
