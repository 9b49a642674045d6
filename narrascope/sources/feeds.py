"""Landed feed documents.

Fetching is not the engine's job: feeds land as files (one folder per feed), are read as binary files
and parsed with Spark's native ``from_xml``, RSS 2.0, RSS 1.0 and Atom with one schema. A malformed feed
is dropped whole and not archived, yet counts as successful; a listed feed with no landed file counts
as failed, and so does one landed without a byte. Each feed is read in its own charset (byte order mark, else XML declaration, else UTF-8); one whose
bytes do not fit it is malformed, alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions.text import WS_CLASS, remove_images
from narrascope.operators.storage import global_rank

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_ITEM = f"struct<title: string, link: {_LINK}, description: string, pubDate: string, date: string>"
_ENTRY = f"struct<title: string, link: {_LINK}, summary: string, content: string, published: string, updated: string>"
#: RSS 2.0 keeps items in the channel, RSS 1.0 beside it, Atom has entries
FEED_SCHEMA = (f"channel struct<title: string, item: array<{_ITEM}>>, item array<{_ITEM}>, "
               f"entry array<{_ENTRY}>, _corrupt_record string")
XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"}

# Offsets of the zone names that RFC 822 lists.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
         "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
#: two-digit years from here on are of the 1900s
CENTURY_CUT = 90


#: first bytes (hex) of byte order marks, longest first, and of UTF-16 text that has none but starts as XML does
MARKS = {"0000FEFF": "UTF-32", "FFFE0000": "UTF-32", "EFBBBF": "UTF-8-SIG", "FEFF": "UTF-16", "FFFE": "UTF-16", "003C003F": "UTF-16BE", "3C003F00": "UTF-16LE"}
_DECLARED = "^\\s*<\\?xml\\s[^>]*?encoding\\s*=\\s*[\"']([A-Za-z0-9._:-]+)[\"']"
HEAD_BYTES = 1024


def charset(content: Column) -> Column:
    """The charset of an XML document's bytes, in upper case: from its mark, else its declaration, else UTF-8."""
    head = F.substring(content, 1, HEAD_BYTES)
    declared = F.regexp_extract(F.decode(head, "ISO-8859-1"), _DECLARED, 1)
    found = F.when(declared != "", F.upper(declared)).otherwise("UTF-8")
    for mark, name in reversed(MARKS.items()):
        found = F.when(F.hex(head).startswith(mark), name).otherwise(found)
    return found


def _decode_batches(contents: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for content, names in contents:
        out = []
        for data, name in zip(content, names.to_pylist()):
            try:
                out.append(data.as_py().decode(name) if data.is_valid else None)
            except (LookupError, ValueError):  # no such charset, or bytes that it does not have
                out.append(None)
        yield pa.array(out, pa.string())


def decoded(content: Column) -> Column:
    """An XML document's text; null if its bytes do not fit its charset, or the charset is not known.

    UTF-8 (nearly all feeds) is decoded natively; other documents alone go through Python's codecs, in Arrow batches.
    """
    name = charset(content)
    utf8 = name.isin("UTF-8", "UTF8", "UTF-8-SIG")
    own = F.regexp_replace(F.try_validate_utf8(F.when(utf8, content).cast("string")), "^\ufeff", "")
    other = F.arrow_udf(_decode_batches, "string")(F.when(~utf8, content), name)
    return F.when(utf8, own).otherwise(other)


def landed_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(feed, content, parsed, good) per landed file; ``feed`` is the folder name ``feed=NAME``."""
    raw = spark.read.format("binaryFile").load(path)
    texts = raw.select("feed", "content", decoded(F.col("content")).alias("xml"))
    return (texts.select("feed", "content", F.from_xml("xml", FEED_SCHEMA, XML_OPTIONS).alias("parsed"))
            .withColumn("good", F.col("parsed").isNotNull() & F.col("parsed._corrupt_record").isNull()))


def strip(col) -> Column:
    """Python's ``str.strip``; null stays null."""
    return F.regexp_replace(col, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def parse_date(col) -> Column:
    """RFC 822 dates (weekday and seconds optional, zone a name, an offset or missing) and ISO 8601, in UTC.

    Two-digit years are taken to be near; null when nothing fits.
    """
    s = F.regexp_replace(strip(col), r"^[A-Za-z]+,?\s+(?=[0-9])", "")
    s = F.regexp_replace(s, r"^([0-9]{1,2})[ -]([A-Za-z]{3})[a-z]*[ -]", "$1 $2 ")
    year = F.regexp_extract(s, "^[0-9]{1,2} [A-Za-z]{3} ([0-9]{2})(?: |$)", 1)
    full = F.when(year.try_cast("int") < CENTURY_CUT, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    s = F.when(year != "", F.concat(F.regexp_extract(s, "^([0-9]{1,2} [A-Za-z]{3} )", 1), full, F.regexp_replace(s, "^[0-9]{1,2} [A-Za-z]{3} [0-9]{2}", ""))).otherwise(s)
    zone = F.upper(F.regexp_extract(s, "^[0-9]{1,2} .* ([A-Za-z]{1,3})$", 1))
    offset = F.lit(None).cast("string")
    for name, to in ZONES.items():
        offset = F.when(zone == name, F.lit(to)).otherwise(offset)
    s = F.when(offset.isNotNull(), F.concat(F.regexp_replace(s, "[A-Za-z]{1,3}$", ""), offset)).otherwise(s)
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy"]
    rfc = [F.try_to_timestamp(s, F.lit(f)) for f in forms]
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{2}"), s.try_cast("timestamp"))
    return F.to_timestamp_ntz(F.coalesce(*rfc, iso))


def _link(links: Column) -> Column:
    """The text of a link element, else the address of the alternate one."""
    text = F.filter(F.transform(links, lambda x: strip(x["_VALUE"])), lambda v: v.isNotNull() & (v != ""))
    alternate = F.filter(links, lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & x["_href"].isNotNull())
    return F.coalesce(F.get(text, F.lit(0)), strip(F.get(alternate, F.lit(0))["_href"]), F.lit(""))


def entries(parsed: str = "parsed") -> Column:
    """The entries of a parsed feed, whatever its format, as (title, url, summary, date)."""
    p = lambda f: F.col(f"{parsed}.{f}")
    kind = "array<struct<title: string, url: string, summary: string, date: string>>"

    def row(title, link, summary, date):
        return F.struct(title.alias("title"), _link(link).alias("url"), summary.alias("summary"), date.alias("date"))

    rss = lambda x: row(x["title"], x["link"], x["description"], F.coalesce(x["pubDate"], x["date"]))
    atom = lambda x: row(x["title"], x["link"], F.coalesce(x["summary"], x["content"]), F.coalesce(x["published"], x["updated"]))
    parts = [F.transform(p("channel.item"), rss), F.transform(p("item"), rss), F.transform(p("entry"), atom)]
    return F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in parts])


def read_feeds(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """Article rows of the landed feeds listed in ``feeds`` (feed, position), as I2 takes them.

    An entry with an empty link is skipped; a missing title becomes ``No Title``; summary = stripped
    description with images removed; ``ord`` numbers the entries by feed position, then place in the feed.
    """
    lf = landed_feeds(spark, path).where("good").join(feeds, "feed")
    items = lf.select("feed", "position", F.posexplode(entries()).alias("pos", "it")).where(F.col("it.url") != "")
    rows = items.select(F.coalesce(strip(F.col("it.title")), F.lit("No Title")).alias("title"), F.col("it.url").alias("url"),
                        remove_images(strip(F.coalesce(F.col("it.summary"), F.lit("")))).alias("summary"),
                        parse_date(F.col("it.date")).alias("published"), F.col("feed").alias("source"), "position", "pos")
    return global_rank(rows, "position", "source", "pos").withColumn("ord", F.col("rank") - 1).drop("rank", "position", "pos")


def feed_stats(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """total_sources, successful, failed, total_articles in one aggregation."""
    lf = landed_feeds(spark, path).select("feed", "good", F.size(F.filter(entries(), lambda x: x["url"] != "")).alias("n"))
    j = feeds.join(lf, "feed", "left")
    return j.agg(F.count("*").alias("total_sources"),
                 F.count("good").alias("successful"),
                 F.count_if(F.col("good").isNull()).alias("failed"),
                 F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).cast("long").alias("total_articles"))


def archive_raw(spark: SparkSession, path: str, out: str, run_id: str) -> str:
    """S3: the raw bytes of each feed that parses, unchanged, under the run (parquet, binary column)."""
    raw = landed_feeds(spark, path).where("good").select(F.lit(run_id).alias("run_id"), F.col("feed").alias("source"), "content")
    raw.write.mode("overwrite").partitionBy("run_id", "source").parquet(out)
    return out
