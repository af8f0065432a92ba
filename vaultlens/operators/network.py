"""Finding hosts: numeric ranges, aliases, NetBIOS reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def in_ranges(ranges: DataFrame, names: DataFrame) -> DataFrame:
    """JN-11: host and ip: the first address of a host's ranges, in order of ranges and numbers, at which it answers by its name.

    ranges: host, pos, address (prefix), start, end. names: ip, hostname. The addresses
    that answer are joined to ranges by prefix, so ranges aren't unrolled.
    """
    answers = names.select("ip", F.lower("hostname").alias("name"), F.substring_index("ip", ".", 3).alias("address"), F.element_at(F.split("ip", "[.]"), -1).try_cast("int").alias("n"))
    hit = ranges.join(answers, "address").filter("n between start and end and lower(host) = name")
    return hit.groupBy("host").agg(F.min_by("ip", F.struct("pos", "n")).alias("ip"))


def by_names(hosts: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN-12: each host's address: the first of its name and aliases that resolves. hosts: host, addresses; resolved: name, ip (null: failed)."""
    tried = hosts.select("host", F.posexplode(F.concat(F.array("host"), F.coalesce("addresses", F.array().cast("array<string>")))).alias("pos", "name"))
    found = tried.join(resolved.filter("ip is not null"), "name").groupBy("host").agg(F.min_by("ip", "pos").alias("ip"))
    return hosts.select("host").join(found, "host", "left")


def netbios_address(lines: DataFrame) -> DataFrame:
    """SRC-18: host, ip of reports by name: the first address in the subnet asked by then, else the first at all.

    lines: host, line_no, line. A subnet that ends in 255 stands for its first three numbers.
    """
    name = r"regexp_replace(host, '([^A-Za-z0-9_-])', '\\\\$1')"
    asked = f"regexp_extract(line, concat('(?i)querying\\\\s+', {name}, '\\\\s+on\\\\s+(\\\\d+.\\\\d+.\\\\d+.\\\\d+)'), 1)"
    ip = f"regexp_extract(line, concat('^\\\\s*(\\\\d+\\\\.\\\\d+\\\\.\\\\d+\\\\.\\\\d+)\\\\s+', {name}), 1)"
    rows = lines.withColumn("asked", F.expr(f"nullif({asked}, '')")).withColumn("ip", F.expr(f"if(asked is null, nullif({ip}, ''), null)"))
    rows = rows.withColumn("subnet", F.expr("if(asked like '%.255', regexp_extract(asked, '^(.*)[.]255$', 1), asked)"))
    upto = W.partitionBy("host").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("subnet", F.last("subnet", ignorenulls=True).over(upto)).filter("ip is not null")
    inside = F.coalesce(F.col("ip").startswith(F.col("subnet")), F.lit(False))
    return rows.groupBy("host").agg(F.min_by("ip", F.struct(~inside, "line_no")).alias("ip"))


#: Fixed value: an entry of a report by address, as the tool prints it.
_ENTRY = r"(?i)^\s*([\w\s-]+?)\s*<(\w{2})> - .*<ACTIVE>"


def netbios_names(lines: DataFrame) -> DataFrame:
    """SRC-19: ip, hostname, username of reports by address: first active entry of kind 00 that is no group, last of kind 03.

    lines: ip, line_no, line. Without a hostname there is no row.
    """
    entry = _ENTRY
    rows = lines.filter(~F.col("line").rlike(r"(?i)<\w{2}> - <GROUP>")).select("ip", "line_no", F.lower(F.regexp_extract("line", entry, 1)).alias("name"), F.regexp_extract("line", entry, 2).alias("kind"))
    return rows.groupBy("ip").agg(
        F.expr("min_by(name, line_no) filter (where kind = '00')").alias("hostname"), F.coalesce(F.expr("max_by(name, line_no) filter (where kind = '03')"), F.lit("")).alias("username")
    ).filter("hostname is not null")
