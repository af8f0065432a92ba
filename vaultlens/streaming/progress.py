"""STR-01, STR-02, STR-09, SRC-17: progress of copies from the output of the copy tool.

Output lines have a task, a place (seq) and text. ``parsed`` finds the fields that a line
updates; ``batch`` folds them over recorded output; ``stream`` keeps the running record of
each task as state. A line may update file counts, and size, percent and speed; lines with the latter
go from the log, others stay. Lines that begin with "log: " are never parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import numbers, text

#: The copy tool's progress lines, and its summary's labels.
FILES = r".*\(xfr#(\d+),\s+\w+-chk=(\d+)/(\d+)\).*"
SIZES = r"\s*([\d,]+)\s+(\d+)%\s+([\d.]+)(\wB)/s\s+(\d+:\d{1,2}:\d{1,2})\s*"
SUMMARY = {"fileCount": "Number of files", "newFileCount": "Number of created files", "fileSize": "Total file size", "newFileSize": "Total transferred file size"}
FIELDS = ("fileSize", "newFileSize", "newFileCount", "fileCount", "speed", "percent")


def lines(chunks: DataFrame, *keys: str) -> DataFrame:
    """FN-19: keys, part, line of output chunks (column value)."""
    return chunks.select(*keys, F.posexplode(text.log_lines(F.col("value"))).alias("part", "line"))


def parsed(rows: DataFrame, fixed: bool = False) -> DataFrame:
    """rows with the fields that each line updates (null: none), emits (whether it reports) and kept (whether it stays in the log)."""
    plain = ~F.col("line").startswith("log: ")
    hit = lambda pattern, i: F.when(plain, F.nullif(F.regexp_extract("line", pattern, i), F.lit("")))
    sized = hit(SIZES, 1)
    summary = {f: F.when(plain & sized.isNull(), numbers.value_after(F.col("line"), label)) for f, label in SUMMARY.items()}
    return rows.withColumns({
        "fileSize": summary["fileSize"],
        "newFileSize": F.coalesce(numbers.grouped_int(sized), summary["newFileSize"]),
        "newFileCount": F.coalesce(summary["newFileCount"], numbers.grouped_int(hit(FILES, 1))),
        "fileCount": F.coalesce(summary["fileCount"], numbers.grouped_int(hit(FILES, 3))),
        "speed": numbers.sized(hit(SIZES, 3), hit(SIZES, 4), fixed),
        "percent": numbers.grouped_int(hit(SIZES, 2)).cast("double"),
        "emits": hit(FILES, 1).isNotNull() | sized.isNotNull(),
        "kept": sized.isNull(),
    })


def batch(rows: DataFrame, key: str = "task", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The running record after every line that reports, of recorded output with parsed fields."""
    upto = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({f: F.last(f, ignorenulls=True).over(upto) for f in FIELDS}).filter("emits").select(key, *order, *FIELDS)


def final(rows: DataFrame, key: str = "task", order: str = "seq") -> DataFrame:
    """The record at the end of each task."""
    return rows.groupBy(key).agg(*[F.expr(f"max_by({f}, {order}) filter (where {f} is not null)").alias(f) for f in FIELDS])


def stream(rows: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The running record of each task as its lines arrive: task, seq and the fields, one row for each line that reports.

    rows: a stream with columns task, seq and parsed fields. A task's lines of one batch are taken in the order of seq. A task is
    forgotten with a line that has ended (where rows have this column), and with forget_ms also after so long without lines; a
    query with the latter goes on for as long as tasks are known, so it isn't for availableNow.
    """
    numbers_ = ", ".join(f"{f} double" for f in FIELDS)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values("seq")
        had = pd.DataFrame([state.get if state.exists else (None,) * len(FIELDS)], columns=list(FIELDS), dtype=float)
        record = pd.concat([had, new[list(FIELDS)].astype(float)]).ffill()
        if "ended" in new and new["ended"].any():
            if state.exists:
                state.remove()
        else:
            state.update(tuple(None if pd.isna(x) else float(x) for x in record.iloc[-1]))
            if forget_ms is not None:
                state.setTimeoutDuration(forget_ms)
        out = record.iloc[1:].reset_index(drop=True)
        out.insert(0, "seq", new["seq"].to_numpy())
        out.insert(0, "task", key[0])
        yield out[new["emits"].to_numpy(dtype=bool)]

    return rows.groupBy("task").applyInPandasWithState(fold, f"task string, seq long, {numbers_}", numbers_, "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def sampled(updates: DataFrame, every: str = "5 seconds", key: str = "task", time: str = "ts", order: str = "seq") -> DataFrame:
    """STR-02: the last record of each task in each span of time. Spans are aligned to the clock, not to a task's first record."""
    rest = [c for c in updates.columns if c not in (key, time)]
    last = updates.groupBy(key, F.window(time, every).alias("w")).agg(F.max_by(F.struct(*rest), F.struct(time, order)).alias("r"))
    return last.select(key, F.col("w.start").alias("at"), "r.*")


def throttled(updates: DataFrame, sink, checkpoint: str, every: str = "5 seconds", key: str = "task", order: str = "seq"):
    """STR-02: a running query that hands sink the latest record of each task at most once in a span of time."""

    def latest(frame: DataFrame, batch_id: int) -> None:
        whole = F.struct(*frame.columns)
        sink(frame.groupBy(key).agg(F.max_by(whole, order).alias("r")).select("r.*"), batch_id)

    return updates.writeStream.foreachBatch(latest).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def followed(events: DataFrame, job_id: int) -> DataFrame:
    """STR-09: a job's own progress, in percent."""
    from ..operators.jobs import normal_progress

    return normal_progress(events.filter(F.col("id") == job_id))
