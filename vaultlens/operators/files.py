"""Files of backups: listings, single entries, tree items, paths. Paths of shares are stored as URL components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text


#: Fixed value: the message that callers know, spelling included.
NOT_ABSOLUTE = "Only absolute path can be used to serach for directory"


def require_absolute(*paths: str) -> None:
    """FLT-05."""
    if not all(p.startswith("/") for p in paths):
        raise ValueError(NOT_ABSOLUTE)


def shares(files: DataFrame, host: str, backup: int) -> DataFrame:
    """SRC-10: top-level shares of a backup, names decoded."""
    mine = files.filter((F.col("host") == host) & (F.col("backup") == backup) & (F.col("path") == "/") & F.col("sharePath").isNull())
    return mine.withColumn("name", text.unmangle(F.col("name")))


def listing(files: DataFrame, host: str, backup: int, share: str, path: str = "/") -> DataFrame:
    """SRC-11: entries of a directory in a share."""
    require_absolute(share, path)
    return files.filter((F.col("host") == host) & (F.col("backup") == backup) & (F.col("sharePath") == share) & (F.col("path") == path))


def entry(files: DataFrame, host: str, backup: int, share: str, path: str) -> DataFrame:
    """SRC-12: one entry, links not followed."""
    parent, _, name = path.rpartition("/")
    return listing(files, host, backup, share, path if not name else parent or "/").filter(F.col("name") == name)


def tree_items(files: DataFrame, path: str, share: str | None = None) -> DataFrame:
    """PRJ-11: entries as tree items: path and fullPath, the extension of files, children (empty) of directories."""
    full = F.concat(F.lit(f"{path}/"), F.col("name"))
    folder = F.col("type") == "DIRECTORY"
    return files.withColumns({
        "path": full if share else F.lit(""),
        "sharePath": F.lit(share) if share else F.col("name"),
        "fullPath": full,
        "file": F.when(~folder, text.extension(F.col("name"))),
        "children": F.when(folder, F.array().cast("array<string>")),
    })


def destination(root: Column, host: Column, *parts: Column) -> Column:
    """PRJ-19: directory of a host, a backup, a log."""
    return F.concat_ws("/", root, host, *[p.cast("string") for p in parts])


def log_file(root: Column, host: Column, number: Column, errors: bool = False) -> Column:
    """PRJ-19, SNK-04: log of a backup; without a number the host's own log."""
    name = F.concat(F.lit("backup."), F.coalesce(F.concat(number.cast("string"), F.lit(".")), F.lit("")), F.lit("error.log" if errors else "log"))
    return F.concat_ws("/", root, host, F.lit("logs"), name)


def log_url(host: Column, number: Column, kind: Column) -> Column:
    """PRJ-23: address of a log: a backup's, or the server's."""
    tail = F.when(kind.contains("error"), "/xferLog.error").otherwise("/xferLog")
    return F.when(host.isNotNull() & number.isNotNull(), F.concat(F.lit("/api/hosts/"), host, F.lit("/backups/"), number.cast("string"), F.lit("/log"), tail)).otherwise(F.concat(F.lit("/api/server/log/"), kind))


def download_action(is_dir: Column, content_type: Column, path: Column) -> tuple[Column, Column]:
    """SNK-02: what a download does ("download" or "zip") and the name that it gets."""
    zipped = is_dir | F.coalesce(content_type == "application/zip", F.lit(False))
    return F.when(zipped, "zip").otherwise("download"), F.when(zipped, F.concat(path, F.lit(".zip"))).otherwise(path)


def foreign_backups(entries: DataFrame, hosts: DataFrame, start_ms: int | None = None, end_ms: int | None = None, host: str | None = None) -> DataFrame:
    """SRC-25, FLT-07, AGG-11, JN-06: dated directories of known hosts: host and its backups (date, path) in name order.

    entries: host, name, target (of a link; null for a directory). Bounds are inclusive; none (or 0) is open.
    """
    from .backups import known

    mine = known(entries, hosts).filter(text.dated(F.col("name"))).withColumn("date", text.date_ms(F.col("name")))
    if host:
        mine = mine.filter(F.col("host") == host)
    if start_ms:
        mine = mine.filter(F.col("date") >= start_ms)
    if end_ms:
        mine = mine.filter(F.col("date") <= end_ms)
    slot = F.struct("name", F.struct("date", F.concat_ws("/", "host", F.coalesce("target", "name")).alias("path")).alias("s"))
    return mine.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(slot)), lambda e: e["s"]).alias("backups"))
