"""STR-04, STR-05, SNK-06: events of the job queue, and a filtered view that they keep up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

#: The topics of each event of the queue.
TOPICS = {
    "waiting": ("jobWaiting",),
    "active": ("jobUpdated",),
    "progress": ("jobUpdated",),
    "completed": ("jobUpdated",),
    "stalled": ("jobUpdated",),
    "failed": ("jobFailed", "jobUpdated"),
    "cleaned": ("jobRemoved",),
    "removed": ("jobRemoved",),
}


def topics(events: DataFrame) -> DataFrame:
    """STR-04: an event's row for each of its topics; a waiting job shows its id only. events: seq, id, event, state, ..."""
    names = F.create_map(*[x for k, v in TOPICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = events.withColumn("topic", F.explode(names[F.col("event")]))
    hidden = [c for c in events.columns if c not in ("seq", "id", "event")]
    return rows.withColumns({c: F.when(F.col("topic") != "jobWaiting", F.col(c)) for c in hidden})


def view(current: DataFrame, updates: DataFrame, states: tuple[str, ...] = ()) -> DataFrame:
    """STR-05: the view of jobs in states (none: all) after updates in the order of seq.

    A job comes in when an update shows it in a wanted state, and goes when one shows it in another; a job that stays keeps the row
    with which it came in. current: id and columns; updates: seq, event (removed jobs go) and the same columns.
    """
    wanted = F.col("state").isin(*states) if states else F.lit(True)
    rows = updates.withColumn("stays", wanted & (F.col("event") != "removed"))
    columns = [c for c in current.columns]
    start = current.withColumns({"seq": F.lit(-1).cast("bigint"), "stays": F.lit(True)}).select(*columns, "seq", "stays")
    whole = start.unionByName(rows.select(*columns, F.col("seq").cast("bigint").alias("seq"), "stays"))
    upto = W.partitionBy("id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ended = F.coalesce(F.max(F.when(~F.col("stays"), F.col("seq"))).over(upto), F.lit(-2))
    since = whole.withColumn("ended", ended).filter("stays and seq > ended")
    return since.groupBy("id").agg(F.min_by(F.struct(*columns), "seq").alias("r")).select("r.*")


def maintained(updates: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, states: tuple[str, ...] = ()):
    """STR-05: a running query that keeps a stored view up to date, batch by batch."""
    return updates.writeStream.foreachBatch(lambda frame, _: save(view(load(), frame, states))).option("checkpointLocation", checkpoint).start()


def published(events: DataFrame, path: str, checkpoint: str):
    """SNK-06: a running query that writes events by topic."""
    return topics(events).writeStream.partitionBy("topic").option("checkpointLocation", checkpoint).start(path, format="parquet", outputMode="append")
