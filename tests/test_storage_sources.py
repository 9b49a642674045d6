import datetime as dt
import os

from pyspark.sql import functions as F

from narrascope.operators import storage as W
from narrascope.sources import files as SR

ART = "id long, title string, url string, source string, summary string, published_at timestamp_ntz, " \
      "run_id string, run_date date"


def test_upsert_updates_title_keeps_source(spark):
    d = dt.date(2024, 1, 1)
    old = spark.createDataFrame([(7, "old", "u1", "s1", "x", None, "r1", d)], ART)
    new = spark.createDataFrame([(0, "new", "u1", "y", "s2", None), (1, "n2", "u2", "z", "s2", None)],
                                "ord long, title string, url string, summary string, source string, "
                                "published_at timestamp_ntz")
    got = {r["url"]: r for r in W.upsert_articles(old, new, "r2", "2024-02-01").collect()}
    assert (got["u1"]["id"], got["u1"]["title"], got["u1"]["source"], got["u1"]["run_id"]) == (7, "new", "s1", "r1")
    assert (got["u2"]["id"], got["u2"]["run_id"]) == (8, "r2")


def test_replace_by_key_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "article_id long, word string")
    new = spark.createDataFrame([(1, "c")], "article_id long, word string")
    keys = spark.createDataFrame([(1,), (2,)], "article_id long")
    once = W.replace_by_key(old, new, keys)
    twice = W.replace_by_key(once, new, keys)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "c")]


def test_global_rank_is_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("o"))
    got = sorted((r["o"], r["rank"]) for r in W.global_rank(df, "o").collect())
    assert [r for _, r in got] == list(range(1, 5001))


def test_lexicon_loader(spark, tmp_path):
    p = tmp_path / "lex.tsv"
    p.write_text("word\tweight\n  Good \t1\nbad\t-2\nonefield\nbad\tx\ngood\t3\n", encoding="utf-8")
    got = {r["word"]: r["weight"] for r in SR.load_lexicon(spark, str(p)).collect()}
    assert got == {"good": 3.0, "bad": -2.0}


def test_stopwords_loader(spark, tmp_path):
    p = tmp_path / "sw.csv"
    p.write_text(" Yang \nyang,x\n\ndan\n", encoding="utf-8")
    assert sorted(r[0] for r in SR.load_stopwords(spark, str(p)).collect()) == ["dan", "yang"]


def test_jsonl_bad_line_and_bad_date(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"title":"t","url":"u","published":"2024-01-02T03:04:05"}\nnot json\n\n'
                 '{"title":"t2","url":"u2","published":"bad"}\n', encoding="utf-8")
    got = sorted((r["title"], r["published"]) for r in SR.read_jsonl(spark, str(p)).collect())
    assert got == [("t", dt.datetime(2024, 1, 2, 3, 4, 5)), ("t2", None)]


def test_feeds(spark, tmp_path):
    from narrascope.sources import feeds as SF

    good = ('<rss><channel><title>a</title>'
            '<item><title> T1 </title><link> http://x/1 </link><description>&lt;p&gt;hi&lt;img src="i"&gt;&lt;/p&gt;'
            '</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>'
            '<item><link>http://x/2</link><pubDate>garbage</pubDate></item>'
            '<item><title>no link</title></item></channel></rss>')
    for name, body in [("a", good), ("b", "<rss><channel><item>")]:
        os.makedirs(tmp_path / f"feed={name}")
        (tmp_path / f"feed={name}" / "f.xml").write_text(body, encoding="utf-8")
    listed = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feed string, position long")
    rows = sorted((r["title"], r["url"], r["summary"], r["published"])
                  for r in SF.read_feeds(spark, str(tmp_path), listed).collect())
    assert rows == [("No Title", "http://x/2", "", None), ("T1", "http://x/1", "<p>hi</p>", dt.datetime(2024, 1, 1, 10))]
    st = SF.feed_stats(spark, str(tmp_path), listed).first()
    assert (st["total_sources"], st["successful"], st["failed"], st["total_articles"]) == (3, 2, 1, 2)


def test_feeds_in_other_charsets(spark, tmp_path):
    from narrascope.sources import feeds as SF

    body = "<rss><channel><item><title>{}</title><link>http://x/{}</link></item></channel></rss>"
    head = '<?xml version="1.0" encoding="{}"?>'.format
    feeds = {"utf8": "".join([head("utf-8"), body.format("é€", 0)]).encode(), "mark": body.format("é", 1).encode("utf-8-sig"),
             "latin": (head("ISO-8859-1") + body.format("é", 2)).encode("latin-1"), "western": (head("Windows-1252") + body.format("“€”", 3)).encode("cp1252"),
             "le": (head("UTF-16") + body.format("é日", 4)).encode("utf-16-le"), "be": ("\ufeff" + head("utf-16") + body.format("é日😀", 5)).encode("utf-16-be"),
             "none": body.format("plain", 6).encode(), "cyrillic": (head("koi8-r") + body.format("Привет", 7)).encode("koi8-r"), "han": (head("GB18030") + body.format("汉字", 8)).encode("gb18030"),
             "broken": (head("utf-8") + body.format("é", 9)).encode("latin-1"), "unknown": (head("no-such-charset") + body.format("x", 10)).encode(),
             "half": (head("UTF-16") + body.format("x", 11)).encode("utf-16-le") + b"<", "empty": b"", "undefined": (head("windows-1252") + body.format("x", 12)).encode() + b"\x81"}
    for name, data in feeds.items():
        (tmp_path / f"feed={name}").mkdir()
        (tmp_path / f"feed={name}" / "f.xml").write_bytes(data)
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(feeds)], "feed string, position long")
    got = {r["source"]: r["title"] for r in SF.read_feeds(spark, str(tmp_path), listed).collect()}
    assert got == {"utf8": "é€", "mark": "é", "latin": "é", "western": "“€”", "le": "é日", "be": "é日😀", "none": "plain", "cyrillic": "Привет", "han": "汉字"}
    assert tuple(SF.feed_stats(spark, str(tmp_path), listed).first()) == (14, 13, 1, 9)  # a file of no bytes did not land
    out = SF.archive_raw(spark, str(tmp_path), str(tmp_path / "archive"), "r")
    assert {r["source"]: bytes(r["content"]) for r in spark.read.parquet(out).collect()} == {n: feeds[n] for n in got}


def test_melt_stats_numbers_and_json(spark):
    s = spark.createDataFrame([(3, True, {"a": 1})], "n long, ok boolean, d map<string,bigint>")
    got = {r["metric_name"]: (r["metric_value"], r["details"]) for r in W.melt_stats(s, "r", "x").collect()}
    assert got == {"n": (3.0, None), "ok": (1.0, None), "d": (None, '{"a":1}')}


def test_recent_runs_nulls_first_duration_and_errors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("r1", t.date(), t, t + dt.timedelta(days=1, seconds=3723, microseconds=9), "completed", "x" * 50),
            ("r2", t.date(), None, None, "failed", ""),
            ("r3", t.date(), t - dt.timedelta(days=1), t, "completed", None)]
    runs = spark.createDataFrame(rows, "run_id string, run_date date, started_at timestamp_ntz, "
                                       "completed_at timestamp_ntz, status string, errors string")
    got = [(r["run_id"], r["started"], r["duration"], r["errors"]) for r in W.recent_runs(runs, 3).collect()]
    d1 = str(dt.timedelta(days=1, seconds=3723, microseconds=9)).split(".")[0]
    assert got == [("r2", "-", "-", "-"), ("r1", "2024-01-01 00:00", d1, "x" * 45 + "..."),
                   ("r3", "2023-12-31 00:00", str(dt.timedelta(days=1)), "-")]


def test_update_runs_latest_wins_and_unknown_run_is_noop(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("r1", t.date(), t, None, "running", False, False, False, False,
                                   None, None, None, None, None, None)], W.RUN_SCHEMA)
    upd = spark.createDataFrame([
        ("r1", t + dt.timedelta(minutes=1), "collect", {"total_fetched": 5, "bogus": 1}, None, ""),
        ("r1", t + dt.timedelta(minutes=2), None, {"total_fetched": 7}, "completed", None),
        ("r1", t + dt.timedelta(minutes=3), None, None, "failed", "boom"),
        ("zz", t, "clean", {"total_cleaned": 1}, "completed", "x")], W.UPDATE_SCHEMA)
    out = W.update_runs(runs, upd).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["collect_completed"], r["clean_completed"], r["total_fetched"], r["status"], r["errors"]) == \
        (True, False, 7, "failed", "boom")
    assert r["completed_at"] == t + dt.timedelta(minutes=2)


def test_feed_dates(spark):
    import datetime as dt

    from narrascope.sources.feeds import parse_date

    at = dt.datetime(2024, 1, 1, 10, 0)
    forms = {"Mon, 01 Jan 2024 10:00:00 GMT": at, "Mon, 01 Jan 2024 10:00:00 +0000": at, "1 Jan 2024 05:00 EST": at, "Monday, 01 January 2024 12:00:00 +0200": at,
             "01 Jan 24 10:00:00 UT": at, "01 Jan 99 10:00 Z": at.replace(year=1999), "2024-01-01T10:00:00Z": at, "2024-01-01T12:00:00+02:00": at,
             "2024-01-01T10:00": at, "2024-01-01": at.replace(hour=0), "  01-Jan-2024 03:00:00 PDT ": at, "sometime": None, "": None, None: None, "32 Jan 2024 10:00": None}
    df = spark.createDataFrame([(k,) for k in forms], "s string").select("s", parse_date(F.col("s")).alias("d"))
    assert {r["s"]: r["d"] for r in df.collect()} == forms


def test_feed_formats_and_broken_feeds(spark, tmp_path):
    from narrascope.sources import feeds as SF

    rss1 = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
            "<channel><title>c</title></channel><item><title>One</title><link>http://1/</link><description>d &lt;img src='x'&gt;</description><dc:date>2024-01-01T10:00:00Z</dc:date></item></rdf:RDF>")
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="text"> Two </title><link rel="self" href="http://no/"/>'
            '<link rel="alternate" href="http://2/"/><content type="html">body</content><updated>2024-01-01T10:00:00Z</updated></entry><entry><title>no link</title></entry></feed>')
    docs = {"a": rss1, "b": atom, "c": "<rss><channel><item><link>http://3/</link></item>", "d": "<html><body>hi</body></html>"}
    for n, x in docs.items():
        (tmp_path / f"feed={n}").mkdir()
        (tmp_path / f"feed={n}" / "f.xml").write_text(x)
    listed = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 2), ("gone", 3)], "feed string, position long")
    got = [tuple(r) for r in SF.read_feeds(spark, str(tmp_path), listed).orderBy("ord").collect()]
    assert [(g[0], g[1], g[2], str(g[3]), g[4], g[5]) for g in got] == [
        ("One", "http://1/", "d ", "2024-01-01 10:00:00", "a", 0), ("Two", "http://2/", "body", "2024-01-01 10:00:00", "b", 1)]
    assert tuple(SF.feed_stats(spark, str(tmp_path), listed).first()) == (5, 4, 1, 2)
    out = SF.archive_raw(spark, str(tmp_path), str(tmp_path / "out"), "r")
    assert {r["source"] for r in spark.read.parquet(out).collect()} == {"a", "b", "d"}


def test_the_text_of_an_article_is_not_among_what_an_upsert_ranks(spark, monkeypatch):
    import datetime as dt

    from narrascope.operators import storage as W

    cut, seen = W.cut_lineage, []
    monkeypatch.setattr(W, "cut_lineage", lambda df, **k: seen.append(df.columns) or cut(df, **k))
    cols = "id long, title string, url string, source string, summary string, published_at timestamp_ntz, run_id string, run_date date"
    old = spark.createDataFrame([(4, "t", "u4", "s", "x", None, "r1", dt.date(2024, 1, 1)), (9, "t", "u9", None, None, None, "r1", dt.date(2024, 1, 1))], cols)
    new = spark.createDataFrame([("u9", "T9", None, "z", None, 3), ("u1", "T1", "S1", "z", None, 2), ("u0", None, "S0", "z", None, 5)],
                                "url string, title string, summary string, source string, published_at timestamp_ntz, ord long")
    got = sorted(tuple(r)[:5] + tuple(r)[6:] for r in W.upsert_rows(old, new, "r2", "2024-02-01", 9).collect())
    r1, r2 = ("r1", dt.date(2024, 1, 1)), ("r2", dt.date(2024, 2, 1))
    assert got == [(9, "T9", "u9", None, None, *r1), (10, "T1", "u1", "z", "S1", *r2), (11, None, "u0", "z", "S0", *r2)]
    assert seen and not any({"title", "summary"} & set(c) for c in seen)
