"""Text reports of tools as tables. lines: line_no, line (from 0), and whatever keys the report has.

A report's header lines are skipped by number, tokens are parted by spaces and blanks dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import parse_int


def tokens(line: Column) -> Column:
    """FLT-08."""
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def rows(lines: DataFrame, skip: int) -> DataFrame:
    """Lines with tokens t, without the header and blank lines."""
    return lines.filter(F.col("line_no") >= skip).withColumn("t", tokens(F.col("line"))).filter("size(t) > 0")


def space(lines: DataFrame) -> DataFrame:
    """SRC-13: fstype, size, used, free (bytes) of the second line of a disk report in KiB."""
    kib = lambda i: parse_int(F.get("t", F.lit(i))) * 1024
    return rows(lines, 1).filter("line_no = 1").select(F.get("t", F.lit(1)).alias("fstype"), kib(2).alias("size"), kib(3).alias("used"), kib(4).alias("free"))


def quotas(lines: DataFrame) -> DataFrame:
    """SRC-14, AGG-08: id, refr, excl; of an id's lines the last counts."""
    each = rows(lines, 2).select("line_no", F.get("t", F.lit(0)).alias("id"), F.struct(parse_int(F.get("t", F.lit(1))).alias("refr"), parse_int(F.get("t", F.lit(2))).alias("excl")).alias("v"))
    return each.groupBy("id").agg(F.max_by("v", "line_no").alias("v")).select("id", "v.refr", "v.excl")


def subvolumes(lines: DataFrame) -> DataFrame:
    """SRC-15: id, host, number: the first token, and the last two parts of the path in the fourth (one part: host only)."""
    parts = F.split(F.get("t", F.lit(3)), "/")
    two = F.when(F.size(parts) < 2, parts).otherwise(F.slice(parts, -2, 2))
    return rows(lines, 2).select(parse_int(F.get("t", F.lit(0))).alias("id"), two.alias("p")).filter("id >= 0").select("id", F.get("p", F.lit(0)).alias("host"), parse_int(F.get("p", F.lit(1))).alias("number"))


def compression(lines: DataFrame, *keys: str) -> DataFrame:
    """SRC-16: keys and diskUsageStatistics: (diskUsage, uncompressed) by kind in lower case; of a kind's lines the last counts."""
    value = F.struct(parse_int(F.get("t", F.lit(2))).alias("diskUsage"), parse_int(F.get("t", F.lit(3))).alias("uncompressed"))
    each = rows(lines, 2).withColumn("kind", F.lower(F.get("t", F.lit(0)))).groupBy(*keys, "kind").agg(F.max_by(value, "line_no").alias("v"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "v")))).alias("diskUsageStatistics"))


def lines_of(text: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no, line of whole reports (column value)."""
    return text.select(*keys, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def host_groups(hosts: DataFrame, groups: DataFrame) -> DataFrame:
    """SRC-09: each host's group id; missing: -1."""
    return hosts.join(groups, "host", "left").withColumn("qgroup_id", F.coalesce("qgroup_id", F.lit(-1).cast("bigint")))
