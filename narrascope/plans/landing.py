"""Landed files derived by Spark from the driver's tables, for the source keys.

Feeds, JSONL, lexicon and stopword files are written under the shared
checkpoint root (``spark.checkpoint.dir``), so their size grows with the
tables; the source operators then read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.plans.fixtures import Bindings

FEED_BLOCK = 400  # ids per landed feed document (about 20 items per source)
MISSING_FEED = "missing-feed"
_CTRL = "[\u0000-\u0008\u000b\u000c\u000e-\u001f]"


def xml_escape(c) -> F.Column:
    c = F.regexp_replace(F.regexp_replace(c, _CTRL, " "), "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(c, "<", "&lt;"), ">", "&gt;")


def feed_format(source) -> F.Column:
    """0: RSS 2.0, 1: Atom, 2: RSS 1.0, by the number in the source's name."""
    return F.pmod(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(3))


#: charset of a landed feed, by the number in its source's name; ``BROKEN`` sources state UTF-8 but hold another byte
CHARSETS = {"src3": "ISO-8859-1", "src4": "UTF-16", "src5": "windows-1252"}
BROKEN = "src6"
#: what windows-1252 has in place of the C1 control characters
_HIGH = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
CP1252 = bytes(_HIGH).decode("windows-1252"), "".join(map(chr, _HIGH))


def in_charset(xml, source) -> F.Column:
    """The landed bytes of a feed; characters that its charset lacks are question marks.

    The writer ends each file with one byte, a line feed; UTF-16 leaves that half of the last character to it.
    """
    narrow = lambda c, lacks: F.regexp_replace(c, lacks, "?")
    western = narrow(xml, f"[^\\x00-\\x7f\\xa0-\\xff{CP1252[0]}]")
    wide = F.encode(F.concat(F.lit("\ufeff"), narrow(xml, "[^\\x00-\\x{ffff}]")), "UTF-16BE")
    out = F.encode(xml, "UTF-8")
    out = F.when(source == "src3", F.encode(narrow(xml, "[^\\x00-\\xff]"), "ISO-8859-1")).otherwise(out)
    out = F.when(source == "src4", F.concat(wide, F.unhex(F.lit("00")))).otherwise(out)
    out = F.when(source == "src5", F.encode(F.translate(western, *CP1252), "ISO-8859-1")).otherwise(out)
    return F.when(source == BROKEN, F.concat(F.encode(xml, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(out)


def landed_date(at, lang, n) -> F.Column:
    """A date in the forms feeds use, by ``n`` modulo 4; French articles have an unreadable one."""
    day = lambda t: F.date_format(t, "EEE, dd MMM yyyy HH:mm")
    k = n % 4
    return (F.when(lang == "fr", F.lit("sometime"))
            .when(k == 0, F.concat(day(at), F.lit(":00 +0000")))
            .when(k == 1, F.concat(day(at), F.lit(":00 GMT")))
            .when(k == 2, F.concat(day(at - F.expr("INTERVAL 5 HOURS")), F.lit(" EST")))
            .otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))))


def land_feeds(b: Bindings, root: str):
    """One feed per (source, block of FEED_BLOCK ids), RSS 2.0, Atom or RSS 1.0; returns (path, feeds list).

    German articles lose their title element, Spanish ones get a blank link, French ones an unreadable
    date, and the feeds of ``src0`` lack their closing tags (malformed, all text kept). ``CHARSETS`` names the feeds
    that are not in UTF-8, ``BROKEN`` those that say they are.
    """
    a = b.articles.withColumn("fmt", feed_format(F.col("source")))
    feed = F.concat(F.col("source"), F.lit("-"), F.lpad(F.floor(F.col("id") / FEED_BLOCK).cast("string"), 8, "0"))
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    atom, rdf = F.col("fmt") == 1, F.col("fmt") == 2
    title = F.when(F.col("lang") == "de", F.lit("")).otherwise(tag("title", xml_escape(F.col("title"))))
    url = F.when(F.col("lang") == "es", F.lit(" ")).otherwise(xml_escape(F.col("url")))
    link = F.when(atom, F.concat(F.lit('<link rel="self" href="https://feed.example/"/><link href="'), url, F.lit('"/>'))).otherwise(tag("link", url))
    body = xml_escape(F.concat(F.lit("<p>"), F.col("summary"), F.lit("<img src=\"a.png\"/></p>")))
    desc = F.when(atom, F.concat(F.lit('<summary type="html">'), body, F.lit("</summary>"))).otherwise(tag("description", body))
    day = landed_date(F.col("published_at"), F.col("lang"), F.col("id"))
    date = F.when(atom, tag("published", day)).when(rdf, tag("dc:date", day)).otherwise(tag("pubDate", day))
    inner = F.concat(title, link, desc, date)
    item = F.when(atom, tag("entry", inner)).otherwise(tag("item", inner))
    items = a.select(feed.alias("feed"), "id", "source", "fmt", item.alias("item"))
    docs = items.groupBy("feed", "source", "fmt").agg(
        F.min("id").alias("position"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda s: s["item"]), "")
        .alias("items"))  # at most FEED_BLOCK items per group
    head = tag("title", F.col("feed"))
    name = F.lit("UTF-8")
    for source, charset in CHARSETS.items():
        name = F.when(F.col("source") == source, charset).otherwise(name)
    first = F.concat(F.lit('<?xml version="1.0" encoding="'), name, F.lit('"?>'))
    rss2 = F.concat(first, F.lit('<rss version="2.0"><channel>'), head, "items")
    rss2 = F.concat(rss2, F.when(F.col("source") == "src0", F.lit("")).otherwise(F.lit("</channel></rss>")))
    atoms = F.concat(first, F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), head, "items", F.lit("</feed>"))
    rdfs = F.concat(first, F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
                          'xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'),
                    head, F.lit("</channel>"), "items", F.lit("</rdf:RDF>"))
    xml = F.when(atom, atoms).when(rdf, rdfs).otherwise(rss2)
    path = f"{root}/feeds"
    docs.select("feed", in_charset(xml, F.col("source")).cast("string").alias("value")).write.mode("overwrite").partitionBy("feed").text(path)
    listed = docs.select("feed", "position").unionByName(
        b.spark.range(1).select(F.lit(MISSING_FEED).alias("feed"), F.lit(-1).cast("long").alias("position")))
    return path, listed


def land_jsonl(b: Bindings, root: str) -> str:
    """Article lines (German ones with a bad date), a junk line per Spanish article, blanks for French."""
    a = b.articles
    pub = F.when(F.col("lang") == "de", F.lit("not-a-date")).otherwise(
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    good = a.select("id", F.lit(0).alias("k"), F.to_json(F.struct("title", "url", "summary", pub.alias("published"),
                                                                  "source")).alias("value"))
    junk = a.where(F.col("lang") == "es").select(
        "id", F.lit(1).alias("k"), F.concat(F.lit("~"), F.regexp_replace("summary", "[\r\n]", " ")).alias("value"))
    blank = a.where(F.col("lang") == "fr").select("id", F.lit(2).alias("k"), F.lit("").alias("value"))
    path = f"{root}/jsonl"
    (good.unionByName(junk).unionByName(blank).repartitionByRange("id").sortWithinPartitions("id", "k")
     .select("value").write.mode("overwrite").text(path))
    return path


def land_lexicon(b: Bindings, root: str, lexicon: DataFrame) -> str:
    """A TSV with a header, a padded upper-case line overridden by a later one, and bad lines."""
    lx = lexicon.select("word", "weight", F.row_number().over(Window.orderBy("word")).alias("n"))  # lexicon: small
    lines = lx.select(F.col("n"), F.lit(0).alias("k"),
                      F.concat(F.lit("  "), F.upper("word"), F.lit("  \t0")).alias("value")).unionByName(
        lx.select("n", F.lit(1).alias("k"),
                  F.concat("word", F.lit("\t"), F.col("weight").cast("string")).alias("value"))).unionByName(
        lx.select("n", F.lit(2).alias("k"), F.concat(F.lit("junk"), F.col("n").cast("string")).alias("value"))
    ).unionByName(
        lx.select("n", F.lit(3).alias("k"), F.concat(F.lit("bad"), F.col("n").cast("string"), F.lit("\tabc"))
                  .alias("value")))
    header = b.spark.range(1).select(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit("word\tweight").alias("value"))
    path = f"{root}/lexicon"
    (lines.unionByName(header).coalesce(1).sortWithinPartitions("n", "k")  # one resource file, in order
     .select("value").write.mode("overwrite").text(path))
    return path


def land_stopwords(b: Bindings, root: str, stopwords: DataFrame) -> str:
    """A CSV with padded upper-case words, extra fields, repeats and blank lines."""
    s = stopwords
    lines = (s.select(F.concat(F.lit(" "), F.upper("word"), F.lit(" ")).alias("value"))
             .unionByName(s.select(F.concat("word", F.lit(",extra")).alias("value")))
             .unionByName(s.select(F.lit("").alias("value"))))
    path = f"{root}/stopwords"
    lines.write.mode("overwrite").text(path)
    return path
