"""Analytical queries.

The fan-out counts of the reference (joined rows) are computed by
aggregating each side per article before the join, which gives the same
numbers with a join of one row per article and key.
"""

from __future__ import annotations

import datetime as _dt
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.operators.util import cut_lineage

NETWORK_TOP = 50
PHRASES_TOP = 50
PIVOT_LABELS = ("negative", "neutral", "positive")


def _parse(value) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    return _dt.datetime.fromisoformat(str(value))


def date_bounds(start=None, end=None, now: _dt.datetime | None = None):
    """Q1 bounds: end defaults to now, start to end minus 7 days; a bare date is midnight."""
    end_dt = _parse(end) if end is not None else (now or _dt.datetime.now())
    start_dt = _parse(start) if start is not None else end_dt - _dt.timedelta(days=7)
    return start_dt, end_dt


def in_range(df: DataFrame, start=None, end=None, col: str = "published_at") -> DataFrame:
    """Q1: rows with ``start <= col <= end`` (nulls out)."""
    s, e = date_bounds(start, end)
    return df.where(F.col(col).between(F.lit(s).cast("timestamp_ntz"), F.lit(e).cast("timestamp_ntz")))


def _word_is(df: DataFrame, col: str, entity: str) -> Column:
    """The entity ignoring case; a stored ``<col>_lower`` (tables at rest have one) lets the scan prune."""
    stored = f"{col}_lower"
    return (F.col(stored) if stored in df.columns else F.lower(F.col(col))) == F.lower(F.lit(entity))


def trends(articles: DataFrame, mentions: DataFrame, sentiments: DataFrame, entity: str,
           start=None, end=None) -> DataFrame:
    """Q2: (published_date, label, count) of joined rows, ordered by date."""
    arts = in_range(articles, start, end).select(
        F.col("id").alias("article_id"), F.to_date("published_at").alias("published_date"))
    m = (mentions.where(_word_is(mentions, "word", entity))
         .groupBy("article_id").agg(F.count("*").alias("m")))
    # only the sentiment rows of those articles are aggregated
    return (arts.join(m, "article_id").join(sentiments.select("article_id", "label"), "article_id")
            .groupBy("published_date", "label")
            .agg(F.sum("m").cast("long").alias("count"))
            .orderBy("published_date", "label"))


def phrases(articles: DataFrame, framing: DataFrame, entity: str, start=None, end=None,
            n: int = PHRASES_TOP) -> DataFrame:
    """Q3: (framing_phrase, count) distinct articles per phrase; top n by count desc, phrase."""
    arts = in_range(articles, start, end).select(F.col("id").alias("article_id"))
    f = framing.where(_word_is(framing, "entity_word", entity)).select("article_id", "framing_phrase")
    return (f.join(arts, "article_id", "left_semi")
            .groupBy("framing_phrase").agg(F.countDistinct("article_id").alias("count"))
            .orderBy(F.desc("count"), F.asc("framing_phrase")).limit(n))


def entity_articles(articles: DataFrame, mentions: DataFrame, entity: str, start=None, end=None) -> DataFrame:
    """Q4: ids of articles in range that mention the entity (any score)."""
    arts = in_range(articles, start, end).select(F.col("id").alias("article_id"))
    m = mentions.where(_word_is(mentions, "word", entity)).select("article_id")
    return arts.join(m, "article_id", "left_semi")


def network_nodes(articles: DataFrame, mentions: DataFrame, entity: str, start=None, end=None,
                  min_score: float = 0.0, max_score: float = 1.0,
                  groups: Sequence[str] | None = None, n: int = NETWORK_TOP, ids: DataFrame | None = None) -> DataFrame:
    """Q5: (word, entity_group, count) top n words by distinct articles, then word."""
    ids = entity_articles(articles, mentions, entity, start, end) if ids is None else ids
    m = (mentions.join(ids, "article_id", "left_semi")
         .where(~F.col("word").contains("#"))
         .where(F.col("score").between(min_score, max_score)))
    if groups:
        m = m.where(F.col("entity_group").isin(list(groups)) | _word_is(m, "word", entity))
    return (m.groupBy("word")
            .agg(F.max("entity_group").alias("entity_group"),
                 F.countDistinct("article_id").alias("count"))
            .orderBy(F.desc("count"), F.asc("word")).limit(n))


def network_links(articles: DataFrame, mentions: DataFrame, nodes: DataFrame, entity: str,
                  start=None, end=None, ids: DataFrame | None = None) -> DataFrame:
    """Q6: (source, target, value): mention pairs per article with source < target.

    Per article and word the mentions are counted first, so one article gives
    at most one row per pair of node words (``n`` nodes bound this by n(n-1)/2).
    """
    ids = entity_articles(articles, mentions, entity, start, end) if ids is None else ids
    node_words = F.broadcast(nodes.select("word").distinct())  # at most ``n`` rows (Q5 top-n)
    m = (mentions.join(ids, "article_id", "left_semi")
         .join(node_words, "word", "left_semi")
         .groupBy("article_id", "word").agg(F.count("*").alias("c")))
    a, b = m.alias("a"), m.alias("b")
    return (a.join(b, (F.col("a.article_id") == F.col("b.article_id")) & (F.col("a.word") < F.col("b.word")))
            .groupBy(F.col("a.word").alias("source"), F.col("b.word").alias("target"))
            .agg(F.sum(F.col("a.c") * F.col("b.c")).cast("long").alias("value")))


def network(articles: DataFrame, mentions: DataFrame, entity: str, start=None, end=None,
            min_score: float = 0.0, max_score: float = 1.0,
            groups: Sequence[str] | None = None, n: int = NETWORK_TOP):
    """Q7: (nodes, links); a node equal to the entity ignoring case shows group SEARCHED."""
    # the articles and the top words are found once, for nodes and links
    ids = cut_lineage(entity_articles(articles, mentions, entity, start, end))
    raw = cut_lineage(network_nodes(articles, mentions, entity, start, end, min_score, max_score, groups, n, ids))
    nodes = raw.select(F.col("word").alias("id"),
                       F.when(_word_is(raw, "word", entity), F.lit("SEARCHED"))
                       .otherwise(F.col("entity_group")).alias("group"),
                       "count")
    links = network_links(articles, mentions, raw, entity, start, end, ids)
    return nodes, links


def graph_frame(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes and links as one frame tagged ``part`` (node or link)."""
    n = nodes.select(F.lit("node").alias("part"), F.col("id").alias("source"),
                     F.lit(None).cast("string").alias("target"), F.col("group"),
                     F.col("count").cast("long").alias("value"))
    lk = links.select(F.lit("link").alias("part"), "source", "target",
                      F.lit(None).cast("string").alias("group"), F.col("value").cast("long").alias("value"))
    return n.unionByName(lk)


def trend_pivot(trend: DataFrame) -> DataFrame:
    """Q8: one row per date present; negative, neutral, positive counts (0 when absent)."""
    t = trend.select(F.col("published_date").alias("date"), F.lower("label").alias("label"), "count")
    p = t.groupBy("date").pivot("label", list(PIVOT_LABELS)).agg(F.sum("count"))
    return (p.select("date", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in PIVOT_LABELS])
            .orderBy("date"))


def trend_extent(pivot: DataFrame) -> DataFrame:
    """Q9: first date, last date, largest single count."""
    return pivot.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                     F.max(F.greatest(*[F.col(x) for x in PIVOT_LABELS])).cast("long").alias("max_count"))


def exclude_entities(nodes: DataFrame, links: DataFrame, words: Iterable[str]):
    """Q10: drop nodes, and links touching them, whose word is listed (case ignored)."""
    ex = sorted({w.lower() for w in words})
    if not ex:
        return nodes, links
    n = nodes.where(~F.lower("id").isin(ex))
    lk = links.where(~F.lower("source").isin(ex) & ~F.lower("target").isin(ex))
    return n, lk


def hide_searched(nodes: DataFrame, links: DataFrame):
    """Q11: drop the first SEARCHED node (count desc, id) and the links touching it."""
    first = (nodes.where(F.col("group") == "SEARCHED")
             .orderBy(F.desc("count"), F.asc("id")).limit(1).select(F.col("id").alias("_hid")))
    n = nodes.join(F.broadcast(first), nodes["id"] == first["_hid"], "left_anti")
    lk = (links.join(F.broadcast(first), links["source"] == first["_hid"], "left_anti")
          .join(F.broadcast(first), links["target"] == first["_hid"], "left_anti"))
    return n, lk


def ego_network(links: DataFrame, node: str) -> DataFrame:
    """Q12: links that touch the node."""
    return links.where((F.col("source") == node) | (F.col("target") == node))


def paginate(df: DataFrame, order: Sequence[Column], page: int, rows: int = 10) -> DataFrame:
    """Q13: page ``page`` (0-based) of ``rows`` rows in the given order."""
    return df.orderBy(*order).offset(page * rows).limit(rows)


def page_count(df: DataFrame, rows: int = 10) -> DataFrame:
    """Q13: number of pages, ceil(n / rows)."""
    return df.agg(F.ceil(F.count("*") / F.lit(rows)).cast("long").alias("pages"))


def node_groups(nodes: DataFrame) -> DataFrame:
    """Q14: sorted distinct groups of the shown nodes."""
    return nodes.select("group").distinct().orderBy("group")
