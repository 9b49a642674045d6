"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per SURVEY 2 key.

Each callable reads the driver's tables (through ``fixtures.Bindings``) and
runs over the whole of them. The matching DuckDB SQL lives in
``narrascope.plans.oracle_queries``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.functions.arrays import prefix_sum
from narrascope.operators import clean as C
from narrascope.operators import entities as N
from narrascope.operators import framing as FR
from narrascope.operators import queries as Q
from narrascope.operators import sentiment as S
from narrascope.operators.util import cut_lineage
from narrascope.plans import params as P
from narrascope.plans.fixtures import Bindings, html_articles

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BINDINGS: dict[tuple, Bindings] = {}


def register(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


def bindings(spark: SparkSession, sf_dir: str) -> Bindings:
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _BINDINGS:
        _BINDINGS[k] = Bindings(spark, sf_dir)
    return _BINDINGS[k]


# ------------------------------------------------------------ shared views
def mentions(b: Bindings) -> DataFrame:
    """N1a over all articles, long surface forms stored as word pieces."""
    t = N.tag_entities(b.articles, b.gazetteer)
    return t.withColumn("word", F.when(F.length("word") >= P.SUBWORD_MIN_LEN, F.concat(F.lit("##"), "word"))
                        .otherwise(F.col("word")))


def sentiments(b: Bindings) -> DataFrame:
    main = S.analyze_sentiment(b.articles, b.stopwords, b.stem_map, b.positive, b.negative)
    title = S.analyze_sentiment(b.articles, b.stopwords, b.stem_map, b.positive, b.negative,
                                text=F.col("title"), method=P.TITLE_METHOD)
    return main.unionByName(title)


def _network(b: Bindings):
    return Q.network(b.articles, mentions(b), b.entity, P.RANGE_START, P.RANGE_END,
                     P.MIN_SCORE, P.MAX_SCORE, P.GROUPS)


def _trends(b: Bindings) -> DataFrame:
    return Q.trends(b.articles, mentions(b), sentiments(b), b.entity, P.RANGE_START, P.RANGE_END)


# ------------------------------------------------------------ 2.2 scalar text
def _html_col(spark, sf_dir, fn, name):
    h = html_articles(spark, sf_dir)
    return h.select("id", fn(F.col("summary")).alias(name))


@register("remove_images")
def q_remove_images(spark, sf_dir):
    return _html_col(spark, sf_dir, X.remove_images, "cleaned")


@register("strip_html")
def q_strip_html(spark, sf_dir):
    return _html_col(spark, sf_dir, X.strip_html, "text")


@register("normalize_whitespace")
def q_normalize_whitespace(spark, sf_dir):
    d = bindings(spark, sf_dir).table("documents")
    return d.select(F.col("doc_id").alias("id"), X.normalize_whitespace("text").alias("text"))


@register("normalize_text")
def q_normalize_text(spark, sf_dir):
    h = html_articles(spark, sf_dir)
    return h.select("id", X.normalize_text("title").alias("title"), X.normalize_text("summary").alias("summary"))


@register("content_hash")
def q_content_hash(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return a.select("id", X.content_hash(X.normalize_text("title"), X.normalize_text("summary")).alias("content_hash"))


@register("article_text")
def q_article_text(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return a.select("id", X.article_text("title", "summary", ". ").alias("signal_text"),
                    X.article_text("title", "summary", " ").alias("language_text"))


@register("clean_tokens_text")
def q_clean_tokens_text(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return a.select("id", X.clean_for_tokens(X.article_text()).alias("cleaned"))


@register("tokenize")
def q_tokenize(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return a.select("id", F.posexplode(X.tokenize(X.article_text())).alias("pos", "token"))


@register("clean_framing_text")
def q_clean_framing_text(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return a.select("id", X.clean_for_sentences(X.article_text()).alias("cleaned"))


@register("split_sentences")
def q_split_sentences(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return a.select("id", F.posexplode(X.split_sentences(X.clean_for_sentences(X.article_text())))
                    .alias("pos", "sentence"))


# ------------------------------------------------------------ 2.4 sentiment
def _tokens(b: Bindings) -> DataFrame:
    return S.explode_tokens(b.articles.select("id", X.tokenize(X.article_text()).alias("toks")), "id", "toks")


@register("remove_stopwords")
def q_remove_stopwords(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return S.remove_stopwords(_tokens(b), b.stopwords).where(F.col("tok").isNotNull())


@register("stem_tokens")
def q_stem_tokens(spark, sf_dir):
    b = bindings(spark, sf_dir)
    t = S.remove_stopwords(_tokens(b), b.stopwords).where(F.col("tok").isNotNull())
    return S.stem_tokens(t, b.stem_map)


@register("lexicon_score")
def q_lexicon_score(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return S.score_text(b.articles, X.article_text(), b.stopwords, b.stem_map, b.positive, b.negative)


@register("sentiment_label")
def q_sentiment_label(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return S.label_sentiment(S.score_text(b.articles, X.article_text(), b.stopwords, b.stem_map, b.positive, b.negative))


@register("analyze_sentiment")
def q_analyze_sentiment(spark, sf_dir):
    return sentiments(bindings(spark, sf_dir))


@register("sentiment_distribution")
def q_sentiment_distribution(spark, sf_dir):
    return S.sentiment_distribution(sentiments(bindings(spark, sf_dir)))


# ------------------------------------------------------------ 2.5 entities
@register("tag_entities")
def q_tag_entities(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return N.tag_entities(b.articles, b.gazetteer)


@register("explode_entities")
def q_explode_entities(spark, sf_dir):
    """N2 on nested entity lists (fields left out where a model gives none)."""
    b = bindings(spark, sf_dir)
    t = N.tag_entities(b.articles, b.gazetteer)
    e = F.struct(F.when(F.col("entity_group") != "DAT", F.col("entity_group")).alias("entity_group"),
                 F.col("word"),
                 F.when(F.col("score") >= 0.6, F.col("score")).alias("score"),
                 F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    nested = t.groupBy("article_id").agg(F.collect_list(e).alias("entities"))
    nested = nested.select("article_id", F.lit("gazetteer").alias("method"), "entities")
    return N.explode_entities(nested)


@register("framing_targets")
def q_framing_targets(spark, sf_dir):
    return N.framing_targets(mentions(bindings(spark, sf_dir)))


# ------------------------------------------------------------ 2.7 queries
@register("date_range")
def q_date_range(spark, sf_dir):
    a = bindings(spark, sf_dir).articles
    return Q.in_range(a, P.Q1_START, P.Q1_END).select("id", "published_at")


@register("trends")
def q_trends(spark, sf_dir):
    return _trends(bindings(spark, sf_dir))


@register("entity_articles")
def q_entity_articles(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return Q.entity_articles(b.articles, mentions(b), b.entity, P.RANGE_START, P.RANGE_END)


@register("network_nodes")
def q_network_nodes(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return Q.network_nodes(b.articles, mentions(b), b.entity, P.RANGE_START, P.RANGE_END,
                           P.MIN_SCORE, P.MAX_SCORE, P.GROUPS)


@register("network_links")
def q_network_links(spark, sf_dir):
    b = bindings(spark, sf_dir)
    m = mentions(b)
    nodes = Q.network_nodes(b.articles, m, b.entity, P.RANGE_START, P.RANGE_END,
                            P.MIN_SCORE, P.MAX_SCORE, P.GROUPS)
    return Q.network_links(b.articles, m, nodes, b.entity, P.RANGE_START, P.RANGE_END)


@register("network")
def q_network(spark, sf_dir):
    return Q.graph_frame(*_network(bindings(spark, sf_dir)))


@register("trend_pivot")
def q_trend_pivot(spark, sf_dir):
    return Q.trend_pivot(_trends(bindings(spark, sf_dir)))


@register("trend_extent")
def q_trend_extent(spark, sf_dir):
    return Q.trend_extent(Q.trend_pivot(_trends(bindings(spark, sf_dir))))


def _top_words(b: Bindings, k: int) -> list[str]:
    """The k most frequent node words: a UI selection, k is bounded."""
    nodes, _ = _network(b)
    return [r["id"] for r in nodes.orderBy(F.desc("count"), F.asc("id")).limit(k).collect()]


@register("exclude_entities")
def q_exclude_entities(spark, sf_dir):
    b = bindings(spark, sf_dir)
    nodes, links = _network(b)
    # exclude the second and third nodes, written in upper case
    words = [w.upper() for w in _top_words(b, 3)[1:]]
    return Q.graph_frame(*Q.exclude_entities(nodes, links, words))


@register("hide_searched")
def q_hide_searched(spark, sf_dir):
    return Q.graph_frame(*Q.hide_searched(*_network(bindings(spark, sf_dir))))


@register("ego_network")
def q_ego_network(spark, sf_dir):
    b = bindings(spark, sf_dir)
    _, links = _network(b)
    top = _top_words(b, 2)
    return Q.ego_network(links, top[-1] if top else "")


@register("paginate")
def q_paginate(spark, sf_dir):
    b = bindings(spark, sf_dir)
    nodes, _ = _network(b)
    return Q.paginate(nodes, [F.desc("count"), F.asc("id")], P.PAGE, P.PAGE_ROWS)


@register("page_count")
def q_page_count(spark, sf_dir):
    nodes, _ = _network(bindings(spark, sf_dir))
    return Q.page_count(nodes, P.PAGE_ROWS)


@register("node_groups")
def q_node_groups(spark, sf_dir):
    nodes, _ = _network(bindings(spark, sf_dir))
    return Q.node_groups(nodes)


# ------------------------------------------------------------ 2.5 framing
def _targets(b: Bindings) -> DataFrame:
    return N.framing_targets(mentions(b))


def _occ(b: Bindings) -> DataFrame:
    return FR.occurrences(b.articles, _targets(b), b.stopwords)


def _occ_key():
    return ["article_id", "entity_word", "sent_idx", (F.col("start") - 1).alias("token_idx")]


@register("entity_occurrences")
def q_entity_occurrences(spark, sf_dir):
    return _occ(bindings(spark, sf_dir)).select(*_occ_key())


@register("context_windows")
def q_context_windows(spark, sf_dir):
    return FR.windows(_occ(bindings(spark, sf_dir))).select(*_occ_key(), "window")


@register("split_segments")
def q_split_segments(spark, sf_dir):
    return FR.segments(FR.windows(_occ(bindings(spark, sf_dir)))).select(*_occ_key(), "seg_idx", "segment")


@register("trim_stopwords")
def q_trim_stopwords(spark, sf_dir):
    s = FR.trimmed(FR.segments(FR.windows(_occ(bindings(spark, sf_dir)))))
    return s.select(*_occ_key(), "seg_idx", "trimmed")


@register("phrase_rule")
def q_phrase_rule(spark, sf_dir):
    c = FR.candidates(FR.trimmed(FR.segments(FR.windows(_occ(bindings(spark, sf_dir))))))
    return c.select(*_occ_key(), "seg_idx", "cand_idx", "phrase")


@register("maximal_phrases")
def q_maximal_phrases(spark, sf_dir):
    """F8 applied to the candidate lists of each (article, entity)."""
    c = FR.candidates(FR.trimmed(FR.segments(FR.windows(_occ(bindings(spark, sf_dir))))))
    g = c.groupBy("article_id", "entity_word").agg(F.collect_set("phrase").alias("cands"))
    return FR.maximal_by_group(g, ["article_id", "entity_word"], "cands")


def framing(b: Bindings) -> DataFrame:
    return FR.frame_entities(b.articles, _targets(b), b.stopwords)


@register("frame_entities")
def q_frame_entities(spark, sf_dir):
    return framing(bindings(spark, sf_dir))


@register("corpus_phrases")
def q_corpus_phrases(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return FR.corpus_phrases(b.articles, b.entity, b.stopwords)


@register("corpus_phrase_sources")
def q_corpus_phrase_sources(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return FR.corpus_phrase_sources(b.articles, b.entity, b.stopwords)


@register("corpus_maximal")
def q_corpus_maximal(spark, sf_dir):
    b = bindings(spark, sf_dir)
    ap = FR.article_phrases_for(b.articles, b.entity, b.stopwords)
    agg = ap.groupBy("phrase").agg(F.count("*").alias("count"))
    return FR.corpus_maximal(agg)


@register("phrases")
def q_phrases(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return Q.phrases(b.articles, framing(b), b.entity, P.RANGE_START, P.RANGE_END)


# ------------------------------------------------------------ 2.3 cleaning
def _clean(b: Bindings):
    return C.clean_pipeline(b.articles, b.language_model, P.TARGET_LANG)


@register("dedup_greedy")
def q_dedup_greedy(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return C.deduplicate(C.normalize_articles(b.articles)).select("id", "ord", "content_hash", "url")


@register("detect_language")
def q_detect_language(spark, sf_dir):
    b = bindings(spark, sf_dir)
    norm = C.normalize_articles(b.articles)
    from narrascope.operators.language import detect_language
    det = detect_language(norm, b.language_model, X.article_text("title", "summary", " "))
    return C.flag_language(norm, b.language_model, P.TARGET_LANG).join(det, "id").select(
        "id", "detected_lang", "is_target_lang")


@register("clean_articles")
def q_clean_articles(spark, sf_dir):
    _, _, kept = _clean(bindings(spark, sf_dir))
    return kept.select("id", "ord", "title", "summary", "url", "content_hash", "published_at", "source")


@register("clean_stats")
def q_clean_stats(spark, sf_dir):
    b = bindings(spark, sf_dir)
    _, unique, _ = _clean(b)
    return C.clean_stats(b.articles, unique)


@register("limit_articles")
def q_limit_articles(spark, sf_dir):
    return C.limit_articles(bindings(spark, sf_dir).articles, P.LIMIT_N).select("id", "ord", "title")


# ------------------------------------------------------------ 2.6 storage
from narrascope.operators import storage as W  # noqa: E402
import datetime as _dt  # noqa: E402


def at_rest_articles(b: Bindings) -> DataFrame:
    """Run 1's articles table: first row per url (by ord)."""
    w = Window.partitionBy("url").orderBy("ord")
    a = b.articles.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return a.select("id", "title", "url", "source", "summary", "published_at",
                    F.lit(P.RUN1).alias("run_id"), F.lit(_dt.date.fromisoformat(P.RUN1_DATE)).alias("run_date"))


def incoming_articles(b: Bindings) -> DataFrame:
    """Run 2's articles: every document again under url ``2 * id``, title and source changed."""
    a = b.articles
    return a.select(F.col("ord"), F.concat(F.lit(P.URL_PREFIX), (F.col("id") * 2).cast("string")).alias("url"),
                    F.concat(F.lit("updated: "), F.col("title")).alias("title"), "summary",
                    F.lit(P.INCOMING_SOURCE).alias("source"),
                    (F.col("published_at") + F.expr("INTERVAL 1 DAY")).alias("published_at"))


def upserted(b: Bindings) -> DataFrame:
    return W.upsert_articles(at_rest_articles(b), incoming_articles(b), P.RUN2, P.RUN2_DATE)


@register("upsert_articles")
def q_upsert_articles(spark, sf_dir):
    return upserted(bindings(spark, sf_dir))


@register("replace_by_key")
def q_replace_by_key(spark, sf_dir):
    """Rerun of the tagger on the English articles with a stricter method."""
    b = bindings(spark, sf_dir)
    m = mentions(b)
    attempted = b.articles.where(F.col("lang") == P.RERUN_LANG).select(F.col("id").alias("article_id"))
    new = (m.join(attempted, "article_id", "left_semi").where(F.length("word") >= P.RERUN_MIN_WORD)
           .withColumn("method_name", F.lit(P.RERUN_METHOD)))
    return W.replace_by_key(m, new, attempted)


def run_ledger(b: Bindings) -> DataFrame:
    """One run per user that signed up, started at the user's first event."""
    e = b.table("events")
    signed = e.where(F.col("event_type") == "signup").select("user_id").distinct()
    first = e.join(signed, "user_id", "left_semi").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    return first.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.to_date("started_at").alias("run_date"), F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit("running").alias("status"),
        *[F.lit(False).alias(f) for f in W.RUN_FLAGS], *[F.lit(None).cast("long").alias(t) for t in W.RUN_TOTALS],
        F.lit(None).cast("string").alias("errors"))


def run_updates(b: Bindings) -> DataFrame:
    """Every event is an update of its user's run."""
    e = b.table("events")
    et = F.col("event_type")
    stage = (F.when(et == "view", "collect").when(et == "click", "parse").when(et == "purchase", "clean")
             .when(et == "signup", "signal"))
    v = F.floor("value").cast("long")
    stats = (F.when(et == "view", F.create_map(F.lit("total_fetched"), v))
             .when(et == "purchase", F.create_map(F.lit("total_cleaned"), v))
             .when(et == "click", F.create_map(F.lit("not_a_total"), v)))
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                    F.col("ts").cast("timestamp_ntz").alias("event_time"), stage.alias("stage"), stats.alias("stats"),
                    F.when(et == "error", "failed").when(et == "signup", "completed").alias("status"),
                    F.when(et == "error", F.col("props")).otherwise(F.lit("")).alias("errors"))


@register("update_run")
def q_update_run(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return W.update_runs(run_ledger(b), run_updates(b))


@register("melt_stats")
def q_melt_stats(spark, sf_dir):
    b = bindings(spark, sf_dir)
    _, unique, _ = _clean(b)
    clean = W.melt_stats(C.clean_stats(b.articles, unique), P.RUN1, "clean")
    signal = W.melt_stats(S.sentiment_stats(sentiments(b)), P.RUN1, "signal")
    return clean.unionByName(signal)


def event_runs(b: Bindings) -> DataFrame:
    """One finished run per event (FIXTURES ``runs``)."""
    e = b.table("events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.to_date("ts").alias("run_date"),
        F.when(k != "0", ts).alias("started_at"),
        F.when(F.col("event_type") != "error",
               F.expr("timestampadd(SECOND, CAST(floor(value) AS INT), CAST(ts AS TIMESTAMP_NTZ))")).alias("completed_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.repeat(F.col("props"), P.ERROR_REPEAT).alias("errors"))


@register("recent_runs")
def q_recent_runs(spark, sf_dir):
    return W.recent_runs(event_runs(bindings(spark, sf_dir)), P.RECENT_N)


@register("check_integrity")
def q_check_integrity(spark, sf_dir):
    b = bindings(spark, sf_dir)
    runs = run_ledger(b)
    stats = run_updates(b).select("run_id", F.col("stage"), F.col("status").alias("metric_name"))
    ment = cut_lineage(mentions(b))  # tagged once: a table to check, and the targets of the framing
    framed = FR.frame_entities(b.articles, N.framing_targets(ment), b.stopwords)
    tables = {"articles": upserted(b), "sentiment_analysis": sentiments(b), "named_entity_recognition": ment,
              "entity_framing": framed, "pipeline_runs": runs, "run_statistics": stats}
    return W.check_integrity({n: t if t is ment else cut_lineage(t) for n, t in tables.items()})


@register("write_tables")
def q_write_tables(spark, sf_dir):
    """Run 2's articles table written partitioned by run_date, read back."""
    from narrascope.session import scratch_dir
    b = bindings(spark, sf_dir)
    path = W.write_table(upserted(b), "articles", scratch_dir(spark, "tables"))
    return spark.read.parquet(path)


# ------------------------------------------------------------ 2.1 sources and sinks
from narrascope.plans import landing as L  # noqa: E402
from narrascope.sources import feeds as SF  # noqa: E402
from narrascope.sources import files as SR  # noqa: E402


def _landing_root(spark):
    from narrascope.session import scratch_dir
    return scratch_dir(spark, "landing")


@register("read_feeds")
def q_read_feeds(spark, sf_dir):
    b = bindings(spark, sf_dir)
    path, listed = L.land_feeds(b, _landing_root(spark))
    return SF.read_feeds(spark, path, listed)


@register("feed_rejects")
def q_feed_rejects(spark, sf_dir):
    b = bindings(spark, sf_dir)
    path, listed = L.land_feeds(b, _landing_root(spark))
    return SF.feed_stats(spark, path, listed)


@register("archive_raw")
def q_archive_raw(spark, sf_dir):
    b = bindings(spark, sf_dir)
    root = _landing_root(spark)
    path, _ = L.land_feeds(b, root)
    out = SF.archive_raw(spark, path, f"{root}/archive", P.RUN1)
    return spark.read.parquet(out).select("run_id", "source", F.length("content").alias("bytes"))


@register("write_jsonl")
def q_write_jsonl(spark, sf_dir):
    b = bindings(spark, sf_dir)
    a = b.articles.select("title", "url", "summary", F.col("published_at").alias("published"), "source")
    path = SR.write_jsonl(a, f"{_landing_root(spark)}/articles_jsonl")
    return spark.read.text(path)


@register("read_jsonl")
def q_read_jsonl(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return SR.read_jsonl(spark, L.land_jsonl(b, _landing_root(spark)))


@register("load_lexicon")
def q_load_lexicon(spark, sf_dir):
    b = bindings(spark, sf_dir)
    from narrascope.plans.fixtures import lexicon
    return SR.load_lexicon(spark, L.land_lexicon(b, _landing_root(spark), lexicon(b.ranked)))


@register("load_stopwords")
def q_load_stopwords(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return SR.load_stopwords(spark, L.land_stopwords(b, _landing_root(spark), b.stopwords))


# ------------------------------------------------------------ 2.8 repeated runs
def resources(b: Bindings):
    from narrascope.plans.pipeline import Resources
    return Resources(b.stopwords, b.stem_map, b.positive, b.negative, b.gazetteer, b.language_model, P.TARGET_LANG)


def two_runs(spark, sf_dir):
    """I2 twice over overlapping urls: run 1 of all articles, run 2 of the second half, retitled."""
    from narrascope.plans.pipeline import run_pipeline
    from narrascope.session import scratch_dir
    b = bindings(spark, sf_dir)
    root, res = scratch_dir(spark, "tables"), resources(b)
    run_pipeline(spark, b.articles, root, res, run_id=P.RUN1, run_date=_dt.date.fromisoformat(P.RUN1_DATE))
    half = b.articles.agg(F.expr("percentile_disc(0.5) within group (order by ord)").alias("m")).first()["m"]
    again = b.articles.where(F.col("ord") > half).withColumn("title", F.concat(F.lit(P.RETITLE), "title"))
    return run_pipeline(spark, again, root, res, run_id=P.RUN2, run_date=_dt.date.fromisoformat(P.RUN2_DATE))


@register("run_pipeline")
def q_run_pipeline(spark, sf_dir):
    """The articles table at rest after two runs with overlapping urls."""
    return two_runs(spark, sf_dir)["articles"].drop("id")


@register("run_pipeline_framing")
def q_run_pipeline_framing(spark, sf_dir):
    """The entity framing at rest after the same two runs, by article url."""
    out = two_runs(spark, sf_dir)
    return out["entity_framing"].join(out["articles"].select(F.col("id").alias("article_id"), "url"), "article_id").drop("article_id", "entity_word_lower")


@register("incremental_ingest")
def q_incremental_ingest(spark, sf_dir):
    """The articles land as JSONL in two drops; each drop is one AvailableNow run."""
    from narrascope.plans.pipeline import current
    from narrascope.session import scratch_dir
    from narrascope.streaming.ingest import incremental_ingest
    b = bindings(spark, sf_dir)
    base = scratch_dir(spark, "ingest")
    a = b.articles.select("title", "url", "summary",
                          F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), "source", "ord")
    half = a.agg(F.expr("percentile_disc(0.5) within group (order by ord)").alias("m")).first()["m"]
    res = resources(b)

    def land(rows, drop):
        (rows.repartitionByRange("ord").sortWithinPartitions("ord").drop("ord")
         .write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{base}/landing/drop={drop}"))
        incremental_ingest(spark, f"{base}/landing", f"{base}/tables", f"{base}/checkpoint", res)

    land(a.where(F.col("ord") <= half), 1)
    land(a.where(F.col("ord") > half), 2)
    runs = current(spark, f"{base}/tables", "pipeline_runs").select("run_id", "started_at")  # two rows
    named = runs.select("run_id", F.concat(F.lit("batch-"), F.lpad((F.row_number().over(Window.orderBy("started_at")) - 1).cast("string"), 8, "0")).alias("name"))
    arts = current(spark, f"{base}/tables", "articles").drop("id", "run_date")
    return arts.join(named, "run_id").withColumn("run_id", F.col("name")).drop("name")


# ------------------------------------------------------------ N1b: a user model
CAPITALIZED_RUN = "(?<![A-Za-z0-9_])[A-Z][a-z]+(?: [A-Z][a-z]+)*"


def capitalized_runs(articles: DataFrame) -> DataFrame:
    """A native stand-in for a user's model: runs of capitalised ASCII words (no group or score given).

    Output as of ``tag_entities_model``; a run starts after all gaps up to it and all runs before it.
    """
    text = F.coalesce(X.article_text("title", "summary", ". "), F.lit(""))
    found = articles.select(F.col("id").alias("article_id"), text.alias("text")).select(
        "article_id", F.regexp_extract_all("text", F.lit(CAPITALIZED_RUN), F.lit(0)).alias("words"),
        F.transform(F.split("text", CAPITALIZED_RUN), F.length).alias("gaps"))
    steps = F.zip_with(F.slice("gaps", 1, F.size("words")), "words", lambda g, w: g + F.length(w))
    placed = found.select("article_id", F.arrays_zip("words", prefix_sum(steps).alias("ends")).alias("runs"))
    run = lambda r: F.struct(F.lit(None).cast("string").alias("entity_group"), r["words"].alias("word"),
                             F.lit(None).cast("double").alias("score"), (r["ends"] - F.length(r["words"])).alias("start"), r["ends"].alias("end"))
    return placed.select("article_id", F.lit("capitalized_runs").alias("method"), F.transform("runs", run).alias("entities"), F.lit(0).alias("failed"))


@register("capitalized_runs")
@register("tag_entities_model")
def q_tag_entities_model(spark, sf_dir):
    b = bindings(spark, sf_dir)
    return N.explode_entities(capitalized_runs(b.articles))
