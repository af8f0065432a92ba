"""Shards that each hold the sources in the corpus's own proportions.

Rows are shuffled by seed within their source; the k-th of n gets the fractional
rank (k + 1/2) / n. In the order of fractional ranks every stretch holds every
source in proportion, so equal cuts of that order are the shards (law ``rows``:
counts differ by one at most). Both ranks come from range-partitioned sorts
(common.ranked): no source and no shard ever sits in one task.

Edge cases: null sources are one source, last; null or empty text has size 1 and
crc 0; equal rows may change places with each other only, so the result is the
same on a rerun; texts of any length are hashed whole and don't move; an empty table gives no rows; with fewer rows than shards the
first ranks' shards stay empty or hold one row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

SHARDS, SEED = 16, 7


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (the place in the shard, from 0) of every row."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        "source",
        F.col("source").isNull().alias("no_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    )
    order = ["h", "doc_id", "text_crc32", "size"]
    inside = common.ranked(rows, ["no_source", "source", *order], "sharding")
    sources = inside.groupBy("no_source", F.col("source").alias("of")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    sources = sources.withColumnRenamed("no_source", "none")
    mixed = inside.join(sources, (inside.no_source == sources.none) & inside.source.eqNullSafe(sources.of)).withColumn("fraction", F.expr("(rank - first + 0.5D) / n"))
    mixed = mixed.select("doc_id", "source", "no_source", "size", "text_crc32", "h", "fraction")
    placed = common.ranked(mixed, ["fraction", "no_source", "source", *order], "sharding", "place")
    total = placed.agg(F.count("*").alias("total"))  # one row
    shard = F.expr(f"cast(place * {shards} div total as int)")
    # shard s begins at ceil(s * total / shards)
    slot = F.expr(f"place - (shard * total + {shards} - 1) div {shards}")
    return placed.crossJoin(F.broadcast(total)).withColumn("shard", shard).withColumn("slot", slot).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
