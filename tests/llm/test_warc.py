"""WARC round trip: what is written is what is read, assembled per capture."""

import gzip
import glob
import hashlib

from narrascope.llm import warc as W
from narrascope.session import scratch_dir

BIG = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 120 + "</html>"


def expected(rows):
    body = [(i, (h or "").encode()) for i, h in rows]
    top = {}
    for i, b in body:
        if len(b) >= 1000 and i is not None:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, b in body:
        first = top.get(b)
        again = first is not None and i != first
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", str(first) if again else "None"))
    return sorted(out)


def digest(spark, rows):
    df = spark.createDataFrame([(i, f"https://a.example/{i}?q=1\r\nx", h, "z") for i, h in rows], "page_id long, url string, html string, sha string")
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in W.op8_warc(df).collect())


def test_round_trip(spark):
    rows = [(1, BIG), (2, BIG), (9, BIG), (9, BIG), (3, "short"), (4, "short"), (5, None), (6, ""), (None, BIG), (None, "x" * 2000),
            (7, "y" * 1000), (8, "y" * 1000), (10, "z" * 999), (11, "z" * 999), (12, "w" * 3_000_000)]
    assert digest(spark, rows) == expected(rows)
    assert digest(spark, []) == []


def test_archives_are_valid_and_nested_rows_complete(spark):
    path = scratch_dir(spark, "warc-test")
    df = spark.createDataFrame([(1, None, BIG), (2, "http://b.example/x", BIG), (3, "http://c.example/", "ok")], "page_id long, url string, html string")
    W.write_warc(df, path)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    data = b"".join(gzip.open(f).read() for f in files)
    records = list(W.parse_records(data))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and len(records) == 9
    got = {r["url"]: r for r in W.assemble(W.read_records(spark, path)).collect()}
    assert got["http://b.example/x"]["response"]["payload"].decode() == BIG
    assert got[None]["response"]["type"] == "revisit" and got[None]["original"]["payload_bytes"] == len(BIG.encode())
    assert all(r["request"]["fields"].startswith("GET ") and "page_id: " in r["metadata"]["fields"] for r in got.values())


def test_records_come_one_at_a_time_from_a_stream(spark):
    path = scratch_dir(spark, "warc-test")
    df = spark.range(300).selectExpr("id as page_id", "'http://a.example/' as url", "concat(id, repeat('x', 100000)) as html").coalesce(1)
    W.write_warc(df, path)
    file, = glob.glob(path.removeprefix("file:") + "/part-*")
    with gzip.open(file) as stream:
        records = W.parse_records(stream)
        next(records)
        assert stream.tell() < 1_000_000
        assert sum(1 for _ in records) == 899


def test_requests_name_their_target(spark):
    path = scratch_dir(spark, "warc-test")
    urls = ["http://a.example/p/x y?q=1&r=2#part", "http://b.example?only=query", "http://c.example", "no scheme", None]
    W.write_warc(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    first = {r["url"]: r["request"]["fields"].split("\r\n")[0] for r in W.assemble(W.read_records(spark, path)).collect()}
    assert first == {urls[0]: "GET /p/x%20y?q=1&r=2 HTTP/1.1", urls[1]: "GET /?only=query HTTP/1.1", urls[2]: "GET / HTTP/1.1", urls[3]: "GET / HTTP/1.1", None: "GET / HTTP/1.1"}


def test_only_revisits_are_joined_to_their_response(spark):
    rows = [("r1", "response", None), ("r2", "response", None), ("v1", "revisit", "r1"), ("v2", "revisit", "gone")]
    df = spark.createDataFrame([(i, t, None, ref, "u", "d", 1, None, None) for i, t, ref in rows], W.RECORD)
    got = {r["capture_id"]: r["original"] and r["original"]["capture_id"] for r in W.assemble(df).collect()}
    assert got == {"r1": None, "r2": None, "v1": "r1", "v2": None}
