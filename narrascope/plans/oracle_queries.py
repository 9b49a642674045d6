"""Per-key DuckDB SQL (the correctness oracle) for ``__spark_entry__.oracle_sql``."""

from __future__ import annotations

import re

from narrascope.operators.entities import VALUABLE_ENTITY_GROUPS
from narrascope.plans import params as P
from narrascope.plans.landing import BROKEN, CHARSETS, CP1252
from narrascope.plans.oracle import (
    CTES, RECURSIVE, WS, cte, q, sql_clean_sentences, sql_clean_tokens, sql_norm_ws, sql_normalize_text,
    sql_split_sentences, sql_strip_html, sql_text, sql_tokenize, with_ctes,
)

ORACLE: dict[str, str] = {}


def oracle(key: str, final_sql: str, needs: list[str] | None = None):
    ORACLE[key] = with_ctes(final_sql.strip(), needs or [])


def ts(s: str) -> str:
    return f"TIMESTAMP '{s.replace('T', ' ')}'"


ENT = "(SELECT entity FROM entity)"
IN_RANGE = f"published_at BETWEEN {ts(P.RANGE_START)} AND {ts(P.RANGE_END)}"
GROUPS_SQL = "(" + ", ".join(q(g) for g in P.GROUPS) + ")"

cte("html_articles", """
SELECT page_id AS id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, html AS summary, url
FROM pages""")

# ------------------------------------------------------------ 2.2 scalar text
oracle("remove_images", "SELECT page_id AS id, regexp_replace(html, '<img[^>]*>', '', 'g') AS cleaned FROM pages")
oracle("strip_html", f"SELECT page_id AS id, {sql_strip_html('html')} AS text FROM pages")
oracle("normalize_whitespace", f"SELECT doc_id AS id, {sql_norm_ws('text')} AS text FROM documents")
oracle("normalize_text", f"""
SELECT id, {sql_normalize_text('title')} AS title, {sql_normalize_text('summary')} AS summary FROM html_articles""",
       ["html_articles"])
oracle("content_hash", f"""
SELECT id, md5(lower({sql_normalize_text('title')} || '|' || {sql_normalize_text('summary')})) AS content_hash
FROM articles""", ["articles"])
oracle("article_text", f"""
SELECT id, {sql_text()} AS signal_text, {sql_text(sep=' ')} AS language_text FROM articles""", ["articles"])
oracle("clean_tokens_text", f"SELECT id, {sql_clean_tokens(sql_text())} AS cleaned FROM articles", ["articles"])

cte("token_rows", f"""
SELECT id, CAST(unnest(generate_series(0, len(t) - 1)) AS INTEGER) AS pos, unnest(t) AS token
FROM (SELECT id, {sql_tokenize(sql_text())} AS t FROM articles) x""", ["articles"])
oracle("tokenize", "SELECT id, pos, token FROM token_rows", ["token_rows"])
oracle("clean_framing_text", f"SELECT id, {sql_clean_sentences(sql_text())} AS cleaned FROM articles", ["articles"])
oracle("split_sentences", f"""
SELECT id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS pos, unnest(s) AS sentence
FROM (SELECT id, {sql_split_sentences(sql_clean_sentences(sql_text()))} AS s FROM articles) x""", ["articles"])

# ------------------------------------------------------------ 2.4 sentiment
cte("kept_tokens", """
SELECT id AS article_id, pos, token AS tok FROM token_rows
WHERE token NOT IN (SELECT word FROM stopwords)""", ["token_rows", "stopwords"])
oracle("remove_stopwords", "SELECT article_id, pos, tok FROM kept_tokens", ["kept_tokens"])
cte("stemmed_tokens", """
SELECT k.article_id, k.pos, coalesce(m.stem, k.tok) AS tok
FROM kept_tokens k LEFT JOIN stem_map m ON k.tok = m.token""", ["kept_tokens", "stem_map"])
oracle("stem_tokens", "SELECT article_id, pos, tok FROM stemmed_tokens", ["stemmed_tokens"])
oracle("lexicon_score", "SELECT article_id, raw_score FROM sentiment_main_raw", ["sentiment_main_raw"])
oracle("sentiment_label", """
SELECT article_id, raw_score, 'inset' AS method_name,
       CASE WHEN raw_score > 0 THEN 1.0 WHEN raw_score < 0 THEN -1.0 ELSE 0.0 END AS polarity,
       0.0 AS subjectivity,
       CASE WHEN raw_score > 0 THEN 'positive' WHEN raw_score < 0 THEN 'negative' ELSE 'neutral' END AS label
FROM sentiment_main_raw""", ["sentiment_main_raw"])
oracle("analyze_sentiment", "SELECT * FROM sentiments", ["sentiments"])
oracle("sentiment_distribution", """
SELECT coalesce(f.label, c.label) AS label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT unnest(['positive', 'negative', 'neutral']) AS label) f
FULL OUTER JOIN (SELECT label, count(*) AS n FROM sentiments GROUP BY label) c ON f.label = c.label""",
       ["sentiments"])

# ------------------------------------------------------------ 2.5 entities
oracle("tag_entities", "SELECT * FROM tagged", ["tagged"])
oracle("explode_entities", """
SELECT article_id, 'gazetteer' AS method_name,
       CASE WHEN entity_group <> 'DAT' THEN entity_group ELSE 'UNKNOWN' END AS entity_group, word,
       CASE WHEN score >= 0.6 THEN score ELSE 0.0 END AS score, start_char, end_char
FROM tagged""", ["tagged"])
_valuable = "(" + ", ".join(q(g) for g in VALUABLE_ENTITY_GROUPS) + ")"
oracle("framing_targets", f"""
SELECT DISTINCT article_id, word AS entity_word FROM mentions WHERE entity_group IN {_valuable}""", ["mentions"])

# ------------------------------------------------------------ 2.7 queries
oracle("date_range", f"""
SELECT id, published_at FROM articles
WHERE published_at BETWEEN {ts(P.Q1_START)} AND {ts(P.Q1_END)}""", ["articles"])
oracle("trends", f"""
SELECT CAST(a.published_at AS DATE) AS published_date, s.label, count(a.id) AS count
FROM articles a JOIN mentions m ON a.id = m.article_id JOIN sentiments s ON a.id = s.article_id
WHERE lower(m.word) = lower({ENT}) AND a.{IN_RANGE}
GROUP BY 1, 2 ORDER BY 1""", ["articles", "mentions", "sentiments", "entity"])

cte("ent_ids", f"""
SELECT m.article_id FROM mentions m JOIN articles a ON a.id = m.article_id
WHERE a.{IN_RANGE} AND lower(m.word) = lower({ENT})""", ["mentions", "articles", "entity"])
oracle("entity_articles", "SELECT id AS article_id FROM articles WHERE id IN (SELECT article_id FROM ent_ids)",
       ["ent_ids", "articles"])
cte("net_nodes", f"""
SELECT word, max(entity_group) AS entity_group, count(DISTINCT article_id) AS count
FROM mentions
WHERE article_id IN (SELECT article_id FROM ent_ids) AND word NOT LIKE '%#%'
  AND score BETWEEN {P.MIN_SCORE} AND {P.MAX_SCORE}
  AND (entity_group IN {GROUPS_SQL} OR lower(word) = lower({ENT}))
GROUP BY word ORDER BY count DESC, word LIMIT 50""", ["mentions", "ent_ids", "entity"])
oracle("network_nodes", "SELECT * FROM net_nodes", ["net_nodes"])
cte("net_links", """
SELECT n1.word AS source, n2.word AS target, count(n1.article_id) AS value
FROM mentions n1 JOIN mentions n2 ON n1.article_id = n2.article_id
WHERE n1.article_id IN (SELECT article_id FROM ent_ids) AND n1.word < n2.word
  AND n1.word IN (SELECT word FROM net_nodes) AND n2.word IN (SELECT word FROM net_nodes)
GROUP BY n1.word, n2.word""", ["mentions", "ent_ids", "net_nodes"])
oracle("network_links", "SELECT * FROM net_links", ["net_links"])
cte("graph_nodes", f"""
SELECT word AS id, CASE WHEN lower(word) = lower({ENT}) THEN 'SEARCHED' ELSE entity_group END AS "group", count
FROM net_nodes""", ["net_nodes", "entity"])
cte("graph_ranked", 'SELECT *, row_number() OVER (ORDER BY count DESC, id) AS rn FROM graph_nodes', ["graph_nodes"])


def graph_sql(nodes: str, links: str) -> str:
    return f"""
SELECT 'node' AS part, id AS source, CAST(NULL AS VARCHAR) AS target, "group", CAST(count AS BIGINT) AS value FROM {nodes}
UNION ALL
SELECT 'link' AS part, source, target, CAST(NULL AS VARCHAR) AS "group", CAST(value AS BIGINT) AS value FROM {links}"""


oracle("network", graph_sql("graph_nodes", "net_links"), ["graph_nodes", "net_links"])
cte("trend_rows", f"""
SELECT CAST(a.published_at AS DATE) AS published_date, s.label, count(a.id) AS count
FROM articles a JOIN mentions m ON a.id = m.article_id JOIN sentiments s ON a.id = s.article_id
WHERE lower(m.word) = lower({ENT}) AND a.{IN_RANGE}
GROUP BY 1, 2""", ["articles", "mentions", "sentiments", "entity"])
cte("trend_wide", """
SELECT published_date AS date,
       CAST(sum(CASE WHEN lower(label) = 'negative' THEN count ELSE 0 END) AS BIGINT) AS negative,
       CAST(sum(CASE WHEN lower(label) = 'neutral' THEN count ELSE 0 END) AS BIGINT) AS neutral,
       CAST(sum(CASE WHEN lower(label) = 'positive' THEN count ELSE 0 END) AS BIGINT) AS positive
FROM trend_rows GROUP BY published_date""", ["trend_rows"])
oracle("trend_pivot", "SELECT * FROM trend_wide ORDER BY date", ["trend_wide"])
oracle("trend_extent", """
SELECT min(date) AS first_date, max(date) AS last_date,
       CAST(max(greatest(negative, neutral, positive)) AS BIGINT) AS max_count FROM trend_wide""", ["trend_wide"])
cte("excluded_words", "SELECT lower(upper(id)) AS w FROM graph_ranked WHERE rn BETWEEN 2 AND 3", ["graph_ranked"])
cte("kept_nodes", "SELECT id, \"group\", count FROM graph_nodes WHERE lower(id) NOT IN (SELECT w FROM excluded_words)",
    ["graph_nodes", "excluded_words"])
cte("kept_links", """
SELECT * FROM net_links WHERE lower(source) NOT IN (SELECT w FROM excluded_words)
  AND lower(target) NOT IN (SELECT w FROM excluded_words)""", ["net_links", "excluded_words"])
oracle("exclude_entities", graph_sql("kept_nodes", "kept_links"), ["kept_nodes", "kept_links"])
cte("hidden", "SELECT id FROM graph_ranked WHERE \"group\" = 'SEARCHED' ORDER BY rn LIMIT 1", ["graph_ranked"])
cte("shown_nodes", "SELECT id, \"group\", count FROM graph_nodes WHERE id NOT IN (SELECT id FROM hidden)",
    ["graph_nodes", "hidden"])
cte("shown_links", """
SELECT * FROM net_links WHERE source NOT IN (SELECT id FROM hidden) AND target NOT IN (SELECT id FROM hidden)""",
    ["net_links", "hidden"])
oracle("hide_searched", graph_sql("shown_nodes", "shown_links"), ["shown_nodes", "shown_links"])
oracle("ego_network", """
SELECT * FROM net_links
WHERE source = (SELECT id FROM graph_ranked WHERE rn <= 2 ORDER BY rn DESC LIMIT 1)
   OR target = (SELECT id FROM graph_ranked WHERE rn <= 2 ORDER BY rn DESC LIMIT 1)""", ["net_links", "graph_ranked"])
oracle("paginate", f"""
SELECT id, "group", count FROM graph_ranked
WHERE rn > {P.PAGE * P.PAGE_ROWS} AND rn <= {(P.PAGE + 1) * P.PAGE_ROWS}""", ["graph_ranked"])
oracle("node_groups", 'SELECT DISTINCT "group" FROM graph_nodes ORDER BY "group"', ["graph_nodes"])

# ------------------------------------------------------------ 2.5 framing
from narrascope.plans.oracle import sql_split_words, sql_strip_non_word  # noqa: E402


def sql_word_tokens(x: str) -> str:
    return sql_split_words(sql_strip_non_word(f"lower({x})"))


def framing_chain(p: str, pairs_sql: str, pair_deps: list[str]) -> None:
    """CTEs ``{p}_occ`` .. ``{p}_max`` for (article_id, entity_word[, url]) pairs."""
    cte(f"{p}_pairs", pairs_sql, pair_deps)
    cte(f"{p}_sents", f"""
SELECT article_id, CAST(unnest(generate_series(0, len(ss) - 1)) AS INTEGER) AS sent_idx, unnest(ss) AS s
FROM (SELECT id AS article_id, {sql_split_sentences(sql_clean_sentences(sql_text()))} AS ss FROM articles) x""",
        ["articles"])
    cte(f"{p}_qual", f"""
SELECT t.article_id, t.entity_word, s.sent_idx, {sql_word_tokens('s.s')} AS toks,
       {sql_word_tokens('t.entity_word')} AS et
FROM {p}_pairs t JOIN {p}_sents s ON s.article_id = t.article_id AND contains(s.s, lower(t.entity_word))""",
        [f"{p}_pairs", f"{p}_sents"])
    cte(f"{p}_occ", f"""
SELECT article_id, entity_word, sent_idx, toks, et, i FROM (
  SELECT *, unnest(generate_series(1, len(toks) - len(et) + 1)) AS i FROM {p}_qual
  WHERE len(et) >= 1 AND len(toks) >= len(et)) x
WHERE list_slice(toks, i, i + len(et) - 1) = et""", [f"{p}_qual"])
    cte(f"{p}_win", f"""
SELECT *, list_slice(toks, greatest(1, i - 7), least(len(toks), i + len(et) - 1 + 7)) AS win FROM {p}_occ""",
        [f"{p}_occ"])
    cte(f"{p}_wtok", f"""
SELECT article_id, entity_word, sent_idx, i, et, unnest(win) AS tok, unnest(generate_series(1, len(win))) AS wpos
FROM {p}_win""", [f"{p}_win"])
    cte(f"{p}_wmark", f"""
SELECT *, list_contains(et, tok) AS is_ent,
       sum(CASE WHEN list_contains(et, tok) THEN 1 ELSE 0 END)
         OVER (PARTITION BY article_id, entity_word, sent_idx, i ORDER BY wpos) AS cut
FROM {p}_wtok""", [f"{p}_wtok"])
    cte(f"{p}_seg", f"""
SELECT article_id, entity_word, sent_idx, i,
       CAST(dense_rank() OVER (PARTITION BY article_id, entity_word, sent_idx, i ORDER BY cut) - 1 AS INTEGER) AS seg_idx,
       segment FROM (
  SELECT article_id, entity_word, sent_idx, i, cut, list(tok ORDER BY wpos) AS segment
  FROM {p}_wmark WHERE NOT is_ent GROUP BY article_id, entity_word, sent_idx, i, cut) g""", [f"{p}_wmark"])
    cte(f"{p}_bounds", f"""
SELECT article_id, entity_word, sent_idx, i, seg_idx, min(q) AS lo, max(q) AS hi FROM (
  SELECT article_id, entity_word, sent_idx, i, seg_idx, unnest(segment) AS tok,
         unnest(generate_series(1, len(segment))) AS q FROM {p}_seg) x
WHERE tok NOT IN (SELECT word FROM stopwords)
GROUP BY article_id, entity_word, sent_idx, i, seg_idx""", [f"{p}_seg", "stopwords"])
    cte(f"{p}_trim", f"""
SELECT s.article_id, s.entity_word, s.sent_idx, s.i, s.seg_idx, s.segment,
       CASE WHEN b.lo IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_slice(s.segment, b.lo, b.hi) END AS trimmed
FROM {p}_seg s LEFT JOIN {p}_bounds b USING (article_id, entity_word, sent_idx, i, seg_idx)""",
        [f"{p}_seg", f"{p}_bounds"])
    cte(f"{p}_cand", f"""
SELECT article_id, entity_word, sent_idx, i, seg_idx,
       CAST(unnest(generate_series(0, len(ph) - 1)) AS INTEGER) AS cand_idx, unnest(ph) AS phrase FROM (
  SELECT *, CASE WHEN len(trimmed) BETWEEN 2 AND 8 THEN [array_to_string(trimmed, ' ')]
                 WHEN len(trimmed) > 8 THEN [array_to_string(list_slice(trimmed, 1, 6), ' '),
                                             array_to_string(list_slice(trimmed, len(trimmed) - 5, len(trimmed)), ' ')]
                 ELSE CAST([] AS VARCHAR[]) END AS ph
  FROM {p}_trim) x""", [f"{p}_trim"])
    cte(f"{p}_dist", f"SELECT DISTINCT article_id, entity_word, phrase FROM {p}_cand", [f"{p}_cand"])
    cte(f"{p}_max", f"""
SELECT d.* FROM {p}_dist d
WHERE NOT EXISTS (SELECT 1 FROM {p}_dist o WHERE o.article_id = d.article_id AND o.entity_word = d.entity_word
                  AND o.phrase <> d.phrase AND contains(o.phrase, d.phrase))""", [f"{p}_dist"])


framing_chain("fr", f"SELECT DISTINCT article_id, word AS entity_word FROM mentions WHERE entity_group IN {_valuable}",
              ["mentions"])
OCC_COLS = "article_id, entity_word, sent_idx, CAST(i - 1 AS INTEGER) AS token_idx"
oracle("entity_occurrences", f"SELECT {OCC_COLS} FROM fr_occ", ["fr_occ"])
oracle("context_windows", f"SELECT {OCC_COLS}, win AS window FROM fr_win", ["fr_win"])
oracle("split_segments", f"SELECT {OCC_COLS}, seg_idx, segment FROM fr_seg", ["fr_seg"])
oracle("trim_stopwords", f"SELECT {OCC_COLS}, seg_idx, trimmed FROM fr_trim", ["fr_trim"])
oracle("phrase_rule", f"SELECT {OCC_COLS}, seg_idx, cand_idx, phrase FROM fr_cand", ["fr_cand"])
oracle("maximal_phrases", "SELECT article_id, entity_word, phrase FROM fr_max", ["fr_max"])
oracle("frame_entities", """
SELECT article_id, entity_word, phrase AS framing_phrase, 'ngram_window' AS method_name FROM fr_max""", ["fr_max"])
cte("framing", "SELECT article_id, entity_word, phrase AS framing_phrase FROM fr_max", ["fr_max"])
oracle("phrases", f"""
SELECT f.framing_phrase, count(DISTINCT a.id) AS count
FROM framing f JOIN articles a ON a.id = f.article_id
WHERE lower(f.entity_word) = lower({ENT}) AND a.{IN_RANGE}
GROUP BY f.framing_phrase ORDER BY count DESC, f.framing_phrase LIMIT 50""", ["framing", "articles", "entity"])

framing_chain("cp", "SELECT a.id AS article_id, e.entity AS entity_word FROM articles a, entity e",
              ["articles", "entity"])
cte("cp_agg", """
SELECT m.phrase, count(*) AS count, count(DISTINCT CASE WHEN a.url <> '' THEN a.url END) AS n_sources
FROM cp_max m JOIN articles a ON a.id = m.article_id GROUP BY m.phrase""", ["cp_max", "articles"])
cte("cp_kept", """
SELECT * FROM cp_agg a
WHERE NOT EXISTS (SELECT 1 FROM cp_agg b WHERE b.phrase <> a.phrase AND contains(b.phrase, a.phrase))""", ["cp_agg"])
oracle("corpus_maximal", "SELECT phrase, count FROM cp_kept", ["cp_kept"])
oracle("corpus_phrases", "SELECT * FROM cp_kept WHERE count > 1 ORDER BY count DESC, phrase", ["cp_kept"])
oracle("corpus_phrase_sources", """
SELECT DISTINCT m.phrase, a.url FROM cp_max m JOIN articles a ON a.id = m.article_id
WHERE a.url IS NOT NULL AND a.url <> '' AND m.phrase IN (SELECT phrase FROM cp_kept WHERE count > 1)""",
       ["cp_max", "articles", "cp_kept"])

# ------------------------------------------------------------ 2.3 cleaning
cte("normalized", f"""
SELECT id, ord, {sql_normalize_text('title')} AS title, {sql_normalize_text('summary')} AS summary, url,
       published_at, source, lang
FROM articles""", ["articles"])
cte("normalized_h", """
SELECT *, md5(lower(title || '|' || summary)) AS content_hash FROM normalized""", ["normalized"])
# C5 as the sequential rule itself: walk the rows in order, carrying the kept keys.
cte("dd_rows", """
SELECT row_number() OVER (ORDER BY ord) AS rn, id, ord, content_hash AS h, coalesce(url, chr(0)) AS u
FROM normalized_h""", ["normalized_h"])
cte("dd_walk", """
SELECT 0 AS rn, CAST([] AS VARCHAR[]) AS hs, CAST([] AS VARCHAR[]) AS us, false AS keep
UNION ALL
SELECT rn, CASE WHEN keep THEN list_append(hs, h) ELSE hs END, CASE WHEN keep THEN list_append(us, u) ELSE us END, keep
FROM (SELECT r.rn, w.hs, w.us, r.h, r.u, NOT list_contains(w.hs, r.h) AND NOT list_contains(w.us, r.u) AS keep
      FROM dd_walk w JOIN dd_rows r ON r.rn = w.rn + 1) s""", ["dd_rows"], recursive=True)
cte("dd_kept", """
SELECT n.* FROM normalized_h n JOIN dd_rows r ON r.id = n.id JOIN dd_walk w ON w.rn = r.rn WHERE w.keep""",
    ["normalized_h", "dd_rows", "dd_walk"])
oracle("dedup_greedy", "SELECT id, ord, content_hash, url FROM dd_kept", ["dd_kept"])

# The same naive Bayes, trained and scored relationally.
cte("lm_docs", "SELECT lang, lower(coalesce(text, '')) AS t FROM documents WHERE lang IS NOT NULL")
cte("lm_counts", """
SELECT lang, substr(t, i, 3) AS gram, count(*) AS c
FROM (SELECT lang, t, unnest(generate_series(1, length(t) - 2)) AS i FROM lm_docs) x
GROUP BY lang, gram""", ["lm_docs"])
cte("lm_langs", """
SELECT lang, CAST(round(-ln(total + (SELECT count(DISTINCT gram) FROM lm_counts)) * 1000000) AS BIGINT) AS base,
       CAST(round(ln(docs / (SELECT count(*) FROM lm_docs)) * 1000000) AS BIGINT) AS prior
FROM (SELECT lang, count(*) AS docs, sum(greatest(length(t) - 2, 0)) AS total FROM lm_docs GROUP BY lang) x""",
    ["lm_docs", "lm_counts"])
cte("lm_delta", "SELECT lang, gram, CAST(round(ln(c + 1) * 1000000) AS BIGINT) AS delta FROM lm_counts", ["lm_counts"])
cte("lt_docs", "SELECT id, lower(title || ' ' || summary) AS t FROM normalized", ["normalized"])
cte("lt_best", """
SELECT id, lang FROM (
  SELECT s.id, s.lang, row_number() OVER (PARTITION BY s.id ORDER BY s.score DESC, s.lang DESC) AS rn FROM (
    SELECT h.id, h.lang, l.prior + greatest(length(d.t) - 2, 0) * l.base + h.sd AS score
    FROM (SELECT g.id, m.lang, sum(m.delta) AS sd
          FROM (SELECT id, substr(t, i, 3) AS gram
                FROM (SELECT id, t, unnest(generate_series(1, length(t) - 2)) AS i FROM lt_docs) a) g
          JOIN lm_delta m ON m.gram = g.gram GROUP BY g.id, m.lang) h
    JOIN lm_langs l ON l.lang = h.lang JOIN lt_docs d ON d.id = h.id) s) r
WHERE rn = 1""", ["lt_docs", "lm_delta", "lm_langs"])
cte("detected", f"""
SELECT n.id, n.ord, b.lang AS detected_lang,
       (length(n.title || ' ' || n.summary) >= 20 AND coalesce(b.lang = '{P.TARGET_LANG}', false)) AS is_target_lang
FROM normalized n LEFT JOIN lt_best b ON b.id = n.id""", ["normalized", "lt_best"])
oracle("detect_language", "SELECT id, detected_lang, is_target_lang FROM detected", ["detected"])
cte("unique_flagged", """
SELECT k.*, d.is_target_lang FROM dd_kept k JOIN detected d ON d.id = k.id""", ["dd_kept", "detected"])
oracle("clean_articles", """
SELECT id, ord, title, summary, url, content_hash, published_at, source FROM unique_flagged WHERE is_target_lang""",
       ["unique_flagged"])
oracle("clean_stats", """
SELECT CAST(count(*) AS BIGINT) AS total_input, CAST(count(u.is_target_lang) AS BIGINT) AS after_dedup,
       CAST(count_if(u.is_target_lang) AS BIGINT) AS target_lang_only,
       CAST(count_if(u.is_target_lang IS NULL) AS BIGINT) AS removed_duplicates,
       CAST(count_if(NOT u.is_target_lang) AS BIGINT) AS removed_other_lang
FROM articles a LEFT JOIN unique_flagged u ON u.ord = a.ord""", ["articles", "unique_flagged"])
oracle("limit_articles", f"SELECT id, ord, title FROM articles ORDER BY ord LIMIT {P.LIMIT_N}", ["articles"])

# ------------------------------------------------------------ 2.6 storage
cte("w_existing", f"""
SELECT id, title, url, source, summary, published_at, '{P.RUN1}' AS run_id, DATE '{P.RUN1_DATE}' AS run_date
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM articles) x WHERE rn = 1""", ["articles"])
cte("w_incoming", f"""
SELECT ord, '{P.URL_PREFIX}' || CAST(id * 2 AS VARCHAR) AS url, 'updated: ' || title AS title, summary,
       '{P.INCOMING_SOURCE}' AS source, published_at + INTERVAL 1 DAY AS published_at
FROM articles""", ["articles"])
cte("w_upserted", f"""
SELECT e.id, i.title, e.url, e.source, i.summary, e.published_at, e.run_id, e.run_date
FROM w_existing e JOIN w_incoming i ON e.url = i.url
UNION ALL
SELECT * FROM w_existing WHERE url NOT IN (SELECT url FROM w_incoming)
UNION ALL
SELECT CAST((SELECT max(id) FROM w_existing) + row_number() OVER (ORDER BY ord) AS BIGINT), title, url, source,
       summary, published_at, '{P.RUN2}', DATE '{P.RUN2_DATE}'
FROM w_incoming WHERE url NOT IN (SELECT url FROM w_existing)""", ["w_existing", "w_incoming"])
oracle("upsert_articles", "SELECT * FROM w_upserted", ["w_upserted"])
oracle("replace_by_key", f"""
SELECT * FROM mentions WHERE article_id NOT IN (SELECT id FROM articles WHERE lang = '{P.RERUN_LANG}')
UNION ALL
SELECT article_id, '{P.RERUN_METHOD}' AS method_name, entity_group, word, score, start_char, end_char
FROM mentions WHERE article_id IN (SELECT id FROM articles WHERE lang = '{P.RERUN_LANG}')
  AND length(word) >= {P.RERUN_MIN_WORD}""", ["mentions", "articles"])

cte("w_ledger", """
SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, CAST(min(ts) AS DATE) AS run_date, min(ts) AS started_at
FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id""")
cte("w_updates", """
SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, ts AS event_time,
       CASE event_type WHEN 'view' THEN 'collect' WHEN 'click' THEN 'parse' WHEN 'purchase' THEN 'clean'
                       WHEN 'signup' THEN 'signal' END AS stage,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS total_fetched,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS total_cleaned,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed' END AS status,
       CASE WHEN event_type = 'error' THEN props ELSE '' END AS errors
FROM events""")
oracle("update_run", """
SELECT l.run_id, l.run_date, l.started_at, u.completed_at, coalesce(u.status, 'running') AS status,
       coalesce(u.c1, false) AS collect_completed, coalesce(u.c2, false) AS parse_completed,
       coalesce(u.c3, false) AS clean_completed, coalesce(u.c4, false) AS signal_completed,
       CAST(NULL AS BIGINT) AS total_sources, u.total_fetched, CAST(NULL AS BIGINT) AS total_parsed,
       u.total_cleaned, CAST(NULL AS BIGINT) AS total_analyzed, u.errors
FROM w_ledger l LEFT JOIN (
  SELECT run_id, bool_or(stage = 'collect') AS c1, bool_or(stage = 'parse') AS c2, bool_or(stage = 'clean') AS c3,
         bool_or(stage = 'signal') AS c4,
         arg_max(total_fetched, event_time) FILTER (WHERE total_fetched IS NOT NULL) AS total_fetched,
         arg_max(total_cleaned, event_time) FILTER (WHERE total_cleaned IS NOT NULL) AS total_cleaned,
         arg_max(status, event_time) FILTER (WHERE status IS NOT NULL) AS status,
         max(event_time) FILTER (WHERE status = 'completed') AS completed_at,
         arg_max(errors, event_time) FILTER (WHERE errors <> '') AS errors
  FROM w_updates GROUP BY run_id) u ON u.run_id = l.run_id""", ["w_ledger", "w_updates"])

cte("w_dist", """
SELECT coalesce(f.label, c.label) AS label, coalesce(c.n, 0) AS count
FROM (SELECT unnest(['positive', 'negative', 'neutral']) AS label) f
FULL OUTER JOIN (SELECT label, count(*) AS n FROM sentiments GROUP BY label) c ON f.label = c.label""",
    ["sentiments"])
oracle("melt_stats", f"""
SELECT '{P.RUN1}' AS run_id, 'clean' AS stage, metric_name, CAST(metric_value AS DOUBLE) AS metric_value,
       CAST(NULL AS VARCHAR) AS details
FROM (SELECT count(*) AS total_input, count(u.is_target_lang) AS after_dedup,
             count_if(u.is_target_lang) AS target_lang_only, count_if(u.is_target_lang IS NULL) AS removed_duplicates,
             count_if(NOT u.is_target_lang) AS removed_other_lang
      FROM articles a LEFT JOIN unique_flagged u ON u.ord = a.ord) s
UNPIVOT (metric_value FOR metric_name IN (total_input, after_dedup, target_lang_only, removed_duplicates,
                                          removed_other_lang))
UNION ALL
SELECT '{P.RUN1}', 'signal', 'total_analyzed', CAST(sum(count) AS DOUBLE), NULL FROM w_dist
UNION ALL
SELECT '{P.RUN1}', 'signal', 'sentiment_distribution', NULL,
       '{{' || string_agg('"' || label || '":' || CAST(count AS VARCHAR), ',' ORDER BY label) || '}}' FROM w_dist""",
       ["articles", "unique_flagged", "w_dist"])

cte("w_runs", f"""
SELECT 'run-' || CAST(event_id AS VARCHAR) AS run_id, CAST(ts AS DATE) AS run_date,
       CASE WHEN regexp_extract(props, '"k": *([0-9]+)', 1) <> '0' THEN ts END AS started_at,
       CASE WHEN event_type <> 'error' THEN ts + CAST(floor(value) AS INTEGER) * INTERVAL 1 SECOND END AS completed_at,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       repeat(props, {P.ERROR_REPEAT}) AS errors
FROM events""")
oracle("recent_runs", f"""
SELECT run_id, run_date, status, coalesce(strftime(started_at, '%Y-%m-%d %H:%M'), '-') AS started,
       CASE WHEN started_at IS NULL OR completed_at IS NULL THEN '-'
            ELSE (CASE WHEN d // 86400 <> 0 THEN CAST(d // 86400 AS VARCHAR) ||
                        CASE WHEN d // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END)
                 || CAST((d % 86400) // 3600 AS VARCHAR) || ':' || lpad(CAST((d % 3600) // 60 AS VARCHAR), 2, '0')
                 || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') END AS duration,
       CASE WHEN length(errors) > 45 THEN substr(errors, 1, 45) || '...' ELSE coalesce(nullif(errors, ''), '-') END AS errors
FROM (SELECT *, date_diff('second', started_at, completed_at) AS d FROM w_runs) x
ORDER BY started_at DESC NULLS FIRST, run_id LIMIT {P.RECENT_N}""", ["w_runs"])


def _count(rule: str, sql: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) AS violations FROM ({sql}) x"


_TABLES = {"articles": "w_upserted", "sentiment_analysis": "sentiments", "named_entity_recognition": "mentions",
           "entity_framing": "framing", "pipeline_runs": "w_run_rows", "run_statistics": "w_stat_rows"}
cte("w_run_rows", "SELECT run_id, run_date, 'running' AS status FROM w_ledger", ["w_ledger"])
cte("w_stat_rows", "SELECT run_id, stage, status AS metric_name FROM w_updates", ["w_updates"])
_RULES = """
articles not null: title url source run_id run_date
sentiment_analysis not null: article_id method_name polarity label score
named_entity_recognition not null: article_id method_name entity_group word score
entity_framing not null: article_id entity_word framing_phrase
pipeline_runs not null: run_id run_date status
run_statistics not null: run_id stage metric_name
articles length: url=512 source=100 run_id=50
sentiment_analysis length: method_name=50 label=20
named_entity_recognition length: entity_group=50 word=255
entity_framing length: entity_word=255 framing_phrase=255
pipeline_runs length: run_id=50 status=20
run_statistics length: run_id=50 stage=20 metric_name=50
"""
_checks = [_count("articles.url unique", "SELECT url FROM w_upserted GROUP BY url HAVING count(*) > 1"),
           _count("pipeline_runs.run_id unique", "SELECT run_id FROM w_run_rows GROUP BY run_id HAVING count(*) > 1")]
for _line in _RULES.strip().split("\n"):
    _head, _cols = _line.split(": ")
    _name, _kind = _head.split(" ", 1)
    for _c in _cols.split():
        if _kind == "length":
            _c, _n = _c.split("=")
            _checks.append(_count(f"{_name}.{_c} length <= {_n}", f"SELECT 1 FROM {_TABLES[_name]} WHERE length({_c}) > {_n}"))
        else:
            _checks.append(_count(f"{_name}.{_c} not null", f"SELECT 1 FROM {_TABLES[_name]} WHERE {_c} IS NULL"))
_checks += [_count(f"{name}.article_id references articles",
                   f"SELECT 1 FROM {_TABLES[name]} t WHERE NOT EXISTS (SELECT 1 FROM w_upserted a WHERE a.id = t.article_id)")
            for name in ("sentiment_analysis", "named_entity_recognition", "entity_framing")]
_checks += [_count("run_statistics.run_id references pipeline_runs",
                   "SELECT 1 FROM w_stat_rows WHERE run_id NOT IN (SELECT run_id FROM w_run_rows)")]
oracle("check_integrity", "\nUNION ALL\n".join(_checks), list(_TABLES.values()))

# ------------------------------------------------------------ 2.1 sources
oracle("read_jsonl", """
SELECT title, url, summary, CASE WHEN lang = 'de' THEN NULL ELSE published_at END AS published, source
FROM articles""", ["articles"])
oracle("load_lexicon", "SELECT word, weight FROM lexicon", ["lexicon"])
oracle("load_stopwords", "SELECT word FROM stopwords", ["stopwords"])

# ------------------------------------------------------------ 2.8 repeated runs, 2.6 W7
#: derived resources, the same for every run
RESOURCES = {"vocab", "ranked", "stopwords", "lexicon", "positive", "negative", "stem_map", "gazetteer", "entity", "gaz",
             "lm_docs", "lm_counts", "lm_langs", "lm_delta"}


def clone(target: str, suffix: str, base: dict[str, str]) -> str:
    """Copy ``target`` and the CTEs below it, with other inputs: ``base`` maps CTE names to what stands for them."""
    names: list[str] = []

    def visit(n: str) -> None:
        if n in names or n in RESOURCES or n in base:
            return
        for d in CTES[n][1]:
            visit(d)
        names.append(n)

    visit(target)
    to = {n: n + suffix for n in names} | base
    word = re.compile(r"\b(" + "|".join(map(re.escape, to)) + r")\b")
    for n in names:
        sql, deps = CTES[n]
        cte(to[n], word.sub(lambda m: to[m[0]], sql), [to.get(d, d) for d in deps], recursive=n in RECURSIVE)
    return to[target]


MEDIAN = "(SELECT quantile_disc(ord, 0.5) FROM articles)"
CLEAN_COLS = "id, ord, title, summary, url, published_at, source"


def runs_at_rest(p: str, first: str, second: str, ids: tuple[str, str], dates: str) -> None:
    """CTEs ``{p}_1``, ``{p}_2`` (what each run kept) and ``{p}_articles`` (the table after both)."""
    for n, rows in (("1", first), ("2", second)):
        cte(f"{p}_in{n}", rows, ["articles"])
        flagged = clone("unique_flagged", f"_{p}{n}", {"articles": f"{p}_in{n}"})
        cte(f"{p}_{n}", f"SELECT {CLEAN_COLS} FROM {flagged} WHERE is_target_lang", [flagged])
    cte(f"{p}_articles", f"""
SELECT coalesce(b.title, a.title) AS title, a.url, a.source, CASE WHEN b.url IS NULL THEN a.summary ELSE b.summary END AS summary,
       a.published_at, '{ids[0]}' AS run_id{dates.format(P.RUN1_DATE)}
FROM {p}_1 a LEFT JOIN {p}_2 b ON a.url = b.url
UNION ALL
SELECT title, url, source, summary, published_at, '{ids[1]}'{dates.format(P.RUN2_DATE)}
FROM {p}_2 WHERE url NOT IN (SELECT url FROM {p}_1)""", [f"{p}_1", f"{p}_2"])


runs_at_rest("rp", "SELECT * FROM articles", f"SELECT * REPLACE ('{P.RETITLE}' || title AS title) FROM articles WHERE ord > {MEDIAN}",
             (P.RUN1, P.RUN2), ", DATE '{}' AS run_date")
oracle("run_pipeline", "SELECT * FROM rp_articles", ["rp_articles"])
for _n in ("1", "2"):
    _tagged = clone("tagged", f"_rp{_n}", {"articles": f"rp_{_n}"})
    clone("framing", f"_rp{_n}", {"articles": f"rp_{_n}", "mentions": _tagged})
oracle("run_pipeline_framing", """
SELECT a.url, f.entity_word, f.framing_phrase, 'ngram_window' AS method_name
FROM framing_rp1 f JOIN rp_1 a ON a.id = f.article_id WHERE a.url NOT IN (SELECT url FROM rp_2)
UNION ALL
SELECT a.url, f.entity_word, f.framing_phrase, 'ngram_window' FROM framing_rp2 f JOIN rp_2 a ON a.id = f.article_id""",
       ["framing_rp1", "framing_rp2", "rp_1", "rp_2"])
runs_at_rest("ii", f"SELECT * FROM articles WHERE ord <= {MEDIAN}", f"SELECT * FROM articles WHERE ord > {MEDIAN}",
             ("batch-00000000", "batch-00000001"), "")
oracle("incremental_ingest", "SELECT * FROM ii_articles", ["ii_articles"])
oracle("write_tables", "SELECT * FROM w_upserted", ["w_upserted"])

# ------------------------------------------------------------ 2.1 feeds and JSONL
_CTRL_SQL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _landed(x: str) -> str:
    """A text as it comes back from XML: control characters as spaces, line ends as LF."""
    return f"replace(replace(regexp_replace(coalesce({x}, ''), '{_CTRL_SQL}', ' ', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _esc(x: str) -> str:
    return f"replace(replace(replace(regexp_replace(coalesce({x}, ''), '{_CTRL_SQL}', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _fit(x: str) -> str:
    """A text after its feed's charset: what that lacks becomes a question mark."""
    lacks = {"src3": r"[^\x00-\xff]", "src4": r"[^\x00-\x{ffff}]", "src5": rf"[^\x00-\x7f\xa0-\xff{CP1252[0]}]"}
    return "CASE source " + " ".join(f"WHEN '{s}' THEN regexp_replace({x}, '{c}', '?', 'g')" for s, c in lacks.items()) + f" ELSE {x} END"


cte("fd_items", f"""
SELECT *, source || '-' || lpad(CAST(id // 400 AS VARCHAR), 8, '0') AS feed,
       CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3 AS fmt FROM articles""", ["articles"])
cte("fd_rows", f"""
SELECT *, min(id) OVER (PARTITION BY feed) AS position FROM fd_items""", ["fd_items"])
_strip_sql = lambda x: f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"
oracle("read_feeds", f"""
SELECT CASE WHEN lang = 'de' THEN 'No Title' ELSE {_strip_sql(_fit(_landed('title')))} END AS title, url,
       '<p>' || {_fit(_landed('summary'))} || '</p>' AS summary,
       CASE WHEN lang <> 'fr' THEN published_at END AS published, feed AS source,
       row_number() OVER (ORDER BY position, feed, id) - 1 AS ord
FROM fd_rows WHERE source NOT IN ('src0', '{BROKEN}') AND lang <> 'es'""", ["fd_rows"])
oracle("feed_rejects", f"""
SELECT count(DISTINCT feed) + 1 AS total_sources, count(DISTINCT feed) AS successful, CAST(1 AS BIGINT) AS failed,
       count(*) FILTER (WHERE source NOT IN ('src0', '{BROKEN}') AND lang <> 'es') AS total_articles FROM fd_items""", ["fd_items"])
_day = "strftime({}, '%a, %d %b %Y %H:%M')"
cte("fd_xml", f"""
SELECT feed, source, fmt, string_agg(
    CASE WHEN fmt = 1 THEN '<entry>' ELSE '<item>' END ||
    CASE WHEN lang = 'de' THEN '' ELSE '<title>' || {_esc('title')} || '</title>' END ||
    CASE WHEN fmt = 1 THEN '<link rel="self" href="https://feed.example/"/><link href="' ELSE '<link>' END ||
    CASE WHEN lang = 'es' THEN ' ' ELSE {_esc('url')} END || CASE WHEN fmt = 1 THEN '"/>' ELSE '</link>' END ||
    CASE WHEN fmt = 1 THEN '<summary type="html">' ELSE '<description>' END ||
    {_esc("'<p>' || summary || '<img src=\"a.png\"/></p>'")} ||
    CASE WHEN fmt = 1 THEN '</summary>' ELSE '</description>' END ||
    CASE fmt WHEN 1 THEN '<published>' WHEN 2 THEN '<dc:date>' ELSE '<pubDate>' END ||
    CASE WHEN lang = 'fr' THEN 'sometime' WHEN id % 4 = 0 THEN {_day.format('published_at')} || ':00 +0000'
         WHEN id % 4 = 1 THEN {_day.format('published_at')} || ':00 GMT'
         WHEN id % 4 = 2 THEN {_day.format('published_at - INTERVAL 5 HOUR')} || ' EST'
         ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S') || 'Z' END ||
    CASE fmt WHEN 1 THEN '</published></entry>' WHEN 2 THEN '</dc:date></item>' ELSE '</pubDate></item>' END, '' ORDER BY id) AS items
FROM fd_items GROUP BY feed, source, fmt""", ["fd_items"])
cte("fd_docs", f"""
SELECT feed, source, '<?xml version="1.0" encoding="' || CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CHARSETS.items())} ELSE 'UTF-8' END || '"?>' || CASE fmt
    WHEN 1 THEN '<feed xmlns="http://www.w3.org/2005/Atom"><title>' || feed || '</title>' || items || '</feed>'
    WHEN 2 THEN '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" '
                || 'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>' || feed || '</title></channel>' || items || '</rdf:RDF>'
    ELSE '<rss version="2.0"><channel><title>' || feed || '</title>' || items || '</channel></rss>' END || chr(10) AS doc
FROM fd_xml WHERE source NOT IN ('src0', '{BROKEN}')""", ["fd_xml"])
oracle("archive_raw", f"""
SELECT '{P.RUN1}' AS run_id, feed AS source,
       CAST(CASE WHEN source IN ('src3', 'src5') THEN length(doc) WHEN source = 'src4' THEN 2 + 2 * length(doc) ELSE strlen(doc) END AS INTEGER) AS bytes
FROM fd_docs""", ["fd_docs"])
oracle("write_jsonl", """
SELECT CAST(json_object('title', title, 'url', url, 'summary', summary,
            'published', strftime(published_at, '%Y-%m-%dT%H:%M:%S'), 'source', source) AS VARCHAR) AS value FROM articles""",
       ["articles"])
oracle("page_count", f"SELECT CAST(ceil(count(*) / {P.PAGE_ROWS}.0) AS BIGINT) AS pages FROM graph_nodes", ["graph_nodes"])

_RUN = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"
for _key in ("capitalized_runs", "tag_entities_model"):
    # each run is marked (private-use characters), so what stands before a mark gives its offset
    oracle(_key, rf"""
SELECT id AS article_id, 'capitalized_runs' AS method_name, 'UNKNOWN' AS entity_group, split_part(part, chr(57345), 1) AS word, CAST(0 AS DOUBLE) AS score,
       CAST(before AS INTEGER) AS start_char, CAST(before + length(split_part(part, chr(57345), 1)) AS INTEGER) AS end_char
FROM (SELECT *, sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT id, i, parts[i] AS part
            FROM (SELECT id, string_split(regexp_replace(coalesce(title, '') || '. ' || coalesce(summary, ''), '{_RUN}',
                                                         chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM articles),
                 unnest(range(1, len(parts) + 1)) AS r(i)))
WHERE i > 1""", ["articles"])
