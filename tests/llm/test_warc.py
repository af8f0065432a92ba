import gzip
import io
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from vaultlens.llm import warc

SCHEMA = "record_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, digest string"


def test_canonical_urls(spark):
    urls = {
        "HTTP://Ex.Org:80/a/?b=2&a=1#x": "ex.org/a?a=1&b=2",
        "https://ex.org/a?utm_source=q&ref=1": "ex.org/a",
        "https://ex.org": "ex.org",
        "ex.org/A": "ex.org/A",
        "https://ex.org:8080/?reference=1": "ex.org:8080?reference=1",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls


def brute(rows):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [x for x in rows if x[3] == "response" and x[4] == 200 and r[1] and x[1] == r[1] and r[2] and x[2] and x[2] < r[2]]
        best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        h, outcome = r[5] or {}, "unmatched"
        if best:
            s = best[5] or {}
            tag = lambda v: (v or "").removeprefix("W/")
            if r[6] is not None:
                ok = r[6] == best[6]
            elif "etag" in h:
                ok = "etag" in s and tag(h["etag"]) == tag(s["etag"])
            elif "last-modified" in h:
                ok = h["last-modified"] == s.get("last-modified")
            else:
                ok = None
            outcome = {True: "resolved", False: "mismatch", None: "no_validator"}[ok]
        merged = (best[5] or {}) | {k: v for k, v in h.items() if k in warc.PERMITTED} if outcome == "resolved" else None
        out.append((r[0], outcome, best and best[0], merged))
    return out


def test_as_of_join(spark):
    rng, rows = random.Random(3), []
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for k in range(400):
        # one URL holds most of the rows
        url = "hot.org/" if rng.random() < 0.6 else rng.choice(["a.org/x", "b.org", None])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = rng.choice([None, {}, {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "content-length": "5", "date": str(k)}, {"last-modified": rng.choice("ab"), "expires": str(k)}])
        ts = None if rng.random() < 0.03 else start + timedelta(seconds=rng.randrange(60))
        rows.append((k, url, ts, kind, rng.choice([200, 200, 200, 404]) if kind == "response" else 304, headers, rng.choice([None, None, "d1", "d2"])))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"chunk": F.lit(1), "found": F.lit(2), "page": F.lit(3)})
    fixed = [(r[0], None if r[1] is None else r[1].rstrip("/"), *r[2:]) for r in rows]
    have = [(r.record_id, r.outcome, r.response_id, r.headers) for r in warc.resolved(df).collect()]
    assert sorted(have, key=lambda x: x[0]) == sorted(brute(fixed), key=lambda x: x[0])
    assert {o for _, o, _, _ in have} == {"resolved", "mismatch", "no_validator", "unmatched"}
    assert warc.resolved(df.filter("false")).count() == 0


def test_reads_files(spark, tmp_path):
    def record(kind, uri, date, http):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{date}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    data = record("warcinfo", "", "2024-01-01T00:00:00Z", b"x") + record("response", "http://a.org/", "2024-01-01T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\nContent-Length: 4\r\n\r\nbody')
    data += record("revisit", "https://A.org", "2024-01-02T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\nExpires: later\r\n\r\n')
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.warc").write_bytes(b"")
    records = warc.read(spark, str(tmp_path))
    assert {(r.kind, r.status, bytes(r.body)) for r in records.collect()} == {("response", 200, b"body"), ("revisit", 304, b"")}
    (found,) = warc.resolved(records).collect()
    assert found.outcome == "resolved" and found.headers == {"etag": '"1"', "content-length": "4", "expires": "later"}


def test_records_come_from_a_stream(monkeypatch):
    """Members of their own, records across chunks, wrong and missing lengths: against the records as written."""
    monkeypatch.setattr(warc, "CHUNK", 7)

    def record(k, http, length=None):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {k}\r\nWARC-Date: {'2024-01-01T00:00:00Z' if k % 2 else 'no date'}\r\n" + ("" if length == "" else f"Content-Length: {length or len(http)}\r\n")
        return head.encode() + b"\r\n" + http + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 50 + b"\r\n\r\nbody of some length"
    parts = [record(0, http), record(1, http), record(2, http, 30), record(3, http, ""), record(4, http, "many"), record(5, http)]
    want = [(str(k), http.partition(b"\r\n\r\n")[2] if k in (0, 1, 5) else b"", bool(k % 2)) for k in range(6)]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        have = [(r["record_id"], r["body"], r["ts"] is not None) for r in warc.records(io.BytesIO(data))]
        assert have == want
    assert [r["body"] for r in warc.records(io.BytesIO(record(6, http, 10_000)))] == [http.partition(b"\r\n\r\n")[2] + b"\r\n\r\n"]
    assert list(warc.records(io.BytesIO(b""))) == [] == list(warc.records(io.BytesIO(b"WARC/1.1\r\nno end")))


def test_repeated_rows_and_long_headers(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    long = {"etag": '"1"', "x": "y" * 200_000}
    rows = [(1, "a.org", start, "response", 200, long, None)] * 2 + [(2, "a.org", start + timedelta(1), "revisit", 304, {"etag": '"1"'}, None)] * 3
    have = warc.resolved(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.record_id, r.outcome, r.headers["x"]) for r in have] == [(2, "resolved", long["x"])] * 3


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "x"), (2, None, "y"), (3, "http://b.org", None), (4, "http://c.org", "")], "page_id long, url string, html string")
    assert sorted((r.record_id, r.outcome) for r in warc.resolved(warc.records_of_pages(pages)).collect()) == [(1, "resolved"), (2, "unmatched"), (3, "no_validator"), (4, "no_validator")]
