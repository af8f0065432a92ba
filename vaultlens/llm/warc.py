"""WARC revisit records: not-modified captures get back the response that they stand for.

    read(spark, path)          -> records of WARC files (plain or gzip)
    canonical_url(column)      -> the URL by which captures of one page meet
    resolved(records)          -> each revisit with its response, status and merged headers

records: record_id, url, ts (timestamp), kind ("response" or "revisit"), status (HTTP code), headers
(map, names in lower case), digest (payload digest or null). More columns may be there; only these are used.

A revisit is joined as of its time to the latest earlier full response (code 200) of its
canonical URL; of several at one time that with the greatest record_id. It is ``resolved`` if the validators
agree: the payload digest if the revisit has one, else the entity tag (compared weakly), else the date of last
modification. Otherwise it is ``mismatch``, ``no_validator``, or ``unmatched`` if there is no earlier
response. Merged headers are the stored response's, updated by those headers of the revisit
that a not-modified answer may update (PERMITTED).

The as-of join sorts by (URL, time) over range partitions, so one hot URL spreads over as many
tasks as it needs. A running last response is taken within each partition and URL; what a partition
starts with comes from a window over one row for each URL and partition. Bodies never move.

Edge cases: null URL or time: ``unmatched``; null headers count as none; a response without headers still
counts; equal rows give their own rows (the query op5 returns them as they are, its SQL for pages with ids of their own); an empty table gives
no rows; headers of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Headers that a 304 answer may update; those that describe the stored body's form stay.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't name a page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"

RECORD = "record_id string, url string, ts timestamp, kind string, status int, headers map<string,string>, digest string, body binary"


#: Bytes that are read from a file at once.
CHUNK = 1 << 20


class _Stream:
    """A file's bytes, unpacked member by member if it is gzip; no more than a chunk and a record are held."""

    def __init__(self, file):
        self.file, self.data, self.packed, self.unpacker = file, b"", None, None

    def more(self) -> bool:
        raw = self.file.read(CHUNK)
        if self.packed is None:
            self.packed = raw[:2] == b"\x1f\x8b"
        if not self.packed:
            self.data += raw
            return bool(raw)
        while raw:
            self.unpacker = self.unpacker or zlib.decompressobj(31)
            self.data += self.unpacker.decompress(raw)
            raw = self.unpacker.unused_data.lstrip(b"\0") if self.unpacker.eof else b""
            if self.unpacker.eof:
                self.unpacker = None
            if not raw:
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which goes too; None if it doesn't come."""
        start = 0
        while (at := self.data.find(mark, start)) < 0:
            start = max(0, len(self.data) - len(mark) + 1)
            if not self.more():
                return None
        found, self.data = self.data[:at], self.data[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, had = [self.data], len(self.data)
        while had < n:
            self.data = b""
            if not self.more():
                break
            parts.append(self.data)
            had += len(self.data)
        whole = b"".join(parts)
        self.data = whole[n:]
        return whole[:n]


def _block(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in rest) if found}


def records(file) -> Iterator[dict]:
    """The response and revisit records of an open file, one after another."""
    stream = _Stream(file)
    # what stands before a record's version (line ends, the rest of a body longer than it says) is skipped
    while stream.until(b"WARC/") is not None and (raw := stream.until(b"\r\n\r\n")) is not None:
        _, head = _block(raw)
        n = head.get("content-length", "")
        body = stream.take(int(n) if n.isdigit() else 0)
        if (kind := head.get("warc-type")) in ("response", "revisit"):
            http, _, payload = body.partition(b"\r\n\r\n")
            line, headers = _block(http)
            code = (line.split() + ["", ""])[1]
            try:
                ts = datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00"))
            except (KeyError, ValueError):
                ts = None
            yield {"record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "ts": ts, "kind": kind, "status": int(code) if code.isdigit() else None, "headers": list(headers.items()), "digest": head.get("warc-payload-digest"), "body": payload}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files (plain, or gzip whole or by record).

    Spark lists the files; each is read as a stream by one task through pyarrow's file systems, so that a task holds one record and not the file. A record without a content
    length, or with one that isn't a number, has an empty body, and one whose length is too short loses the rest; reading goes on at the next record in both cases. A length
    beyond the file's end takes what is there. A date that can't be read is null.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("kind", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("body", pa.binary())])
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_stream(at, compression=None) as file:
                    rows, size = [], 0
                    for record in records(file):
                        rows.append(record)
                        size += len(record["body"])
                        if len(rows) == 500 or size > 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    # the files' content isn't read here
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(parse, RECORD)


def canonical_url(url: Column) -> Column:
    """Host in lower case without port 80 or 443, path, and the sorted query without tracking parameters; no scheme, fragment or closing slash."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def matched(records: DataFrame) -> DataFrame:
    """Each revisit with ``found``: record_id, ts, digest and headers of the latest earlier full response of its URL, or null."""
    slim = records.select("record_id", canonical_url(F.col("url")).alias("page"), "ts", "kind", "status", F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"), "digest")
    slim = slim.filter("kind = 'revisit' or (kind = 'response' and status = 200 and page is not null and ts is not null)")
    # at one time revisits stand before responses, which are then not earlier
    order = ["page", "ts", "late", "record_id"]
    ranged = slim.withColumn("late", F.expr("kind = 'response'")).repartitionByRange(*order).withColumn("chunk", F.spark_partition_id())
    ranged = common.stored(ranged, "warc").withColumn("response", F.expr("if(late, struct(record_id, ts, digest, headers), null)"))
    last = ranged.filter("late").groupBy("page", "chunk").agg(F.max_by("response", F.struct("ts", "record_id")).alias("last"))
    chunks = ranged.select("page", "chunk").distinct().join(last, ["page", "chunk"], "left")
    carried = chunks.selectExpr("page", "chunk", "last_value(last, true) over (partition by page order by chunk rows between unbounded preceding and 1 preceding) as carried")
    inside = ranged.selectExpr("*", "last_value(response, true) over (partition by page, chunk order by ts, late, record_id rows between unbounded preceding and current row) as inside").filter("not late")
    joined = inside.join(carried.withColumnsRenamed({"page": "_page", "chunk": "_chunk"}), F.expr("page = _page and chunk = _chunk"), "left")
    return joined.select("record_id", "page", "ts", "headers", "digest", F.expr("if(page is null or ts is null, null, coalesce(inside, carried))").alias("found"))


def resolved(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """record_id, page, ts, outcome, response_id, response_ts, headers (merged; null unless resolved) of every revisit."""
    names = ", ".join(f"'{h}'" for h in permitted)
    tag = lambda h: f"regexp_replace({h}['etag'], '^W/', '')"
    outcome = f"""case
        when found is null then 'unmatched'
        when digest is not null then if(coalesce(digest = found.digest, false), 'resolved', 'mismatch')
        when headers['etag'] is not null then if(coalesce({tag("headers")} = {tag("found.headers")}, false), 'resolved', 'mismatch')
        when headers['last-modified'] is not null then if(coalesce(headers['last-modified'] = found.headers['last-modified'], false), 'resolved', 'mismatch')
        else 'no_validator' end"""
    new = f"map_filter(headers, (k, v) -> k in ({names}))"
    merged = f"map_concat(map_filter(found.headers, (k, v) -> not map_contains_key({new}, k)), {new})"
    rows = matched(records).withColumn("outcome", F.expr(outcome))
    return rows.selectExpr("record_id", "page", "ts", "outcome", "found.record_id as response_id", "found.ts as response_ts", f"if(outcome = 'resolved', {merged}, null) as headers")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages table: a day of full responses, one for each page a second apart, and a recheck of each a day later.

    The recheck asks with the page's own entity tag; if another page of the same canonical URL was captured
    since, the tags differ. Rechecks of pages without a tag (empty or null html) carry no validator.
    """
    tag = "if(coalesce(html, '') = '', null, concat('\"', substr(md5(html), 1, 16), '\"'))"
    at = "timestamp_seconds(1700000000L + page_id)"
    later = "timestamp_seconds(1700000000L + page_id + 86400L)"
    stamp = lambda t: f"date_format({t}, 'yyyy-MM-dd HH:mm:ss')"
    full = f"map_filter(map('content-type', 'text/html', 'content-length', cast(octet_length(coalesce(html, '')) as string), 'date', {stamp(at)}, 'etag', {tag}), (k, v) -> v is not null)"
    again = f"map_filter(map('content-length', '0', 'date', {stamp(later)}, 'etag', concat('W/', {tag}), 'cache-control', 'max-age=60'), (k, v) -> v is not null)"
    both = f"inline(array(struct('response' as kind, {at} as ts, 200 as status, {full} as headers), struct('revisit' as kind, {later} as ts, 304 as status, {again} as headers)))"
    rows = pages.select("page_id", "url", "html").selectExpr("page_id", "url", both)
    return rows.selectExpr("page_id as record_id", "url", "ts", "kind", "status", "headers", "cast(null as string) as digest")
