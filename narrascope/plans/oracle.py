"""DuckDB SQL oracles for the registered queries.

Each oracle is written in relational form (unnest, window functions,
NOT EXISTS) over the same views as ``narrascope.plans.fixtures``, so that a
mistake in the array-expression operators does not pass twice.
"""

from __future__ import annotations

import html.entities

from narrascope.plans import params as P

# Fixed values, spelled out apart from the operators': Python's white space and word characters, the
# contractions that split, the code points windows-1252 leaves undefined, and HTML's names.
WS = (r"\x09-\x0d\x1c-\x1f\x20\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}-\x{2029}\x{202f}\x{205f}\x{3000}")
W = r"\p{L}\p{N}_"
CONTRACTIONS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
NO_CP1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
CP1252 = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in NO_CP1252}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- scalar SQL
def sql_text(title="title", summary="summary", sep=". ") -> str:
    return f"(coalesce({title}, '') || {q(sep)} || coalesce({summary}, ''))"


def sql_norm_ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{WS}]+', ' ', 'g'))"


def sql_decode_entities(x: str) -> str:
    table = {}
    for k, v in html.entities.html5.items():
        table[k.replace(";", "")] = v
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"
    low = "MAP {" + ", ".join(f"{n}: {q(v)}" for n, v in CP1252.items()) + "}"
    cp = lambda n: (f"(CASE WHEN {n} BETWEEN 128 AND 159 AND {low}[{n}] IS NOT NULL THEN {low}[{n}] "  # noqa: E731
                    f"WHEN {n} > 0 AND {n} <= 1114111 AND NOT ({n} BETWEEN 55296 AND 57343) "
                    f"THEN chr(CAST({n} AS INTEGER)) ELSE chr(65533) END)")
    dec = "regexp_extract(p, '^#([0-9]+)', 1)"
    hexa = "regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1)"
    name = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*)', 1)"
    big = lambda d, v: f"(CASE WHEN length({d}) <= 12 THEN CAST({v} AS BIGINT) ELSE -1 END)"
    body = (f"CASE WHEN i = 1 THEN p "
            f"WHEN {dec} <> '' THEN {cp(big(dec, dec))} || regexp_replace(p, '^#[0-9]+;?', '') "
            f"WHEN {hexa} <> '' THEN {cp(big(hexa, chr(39) + '0x' + chr(39) + ' || ' + hexa))} "
            f"|| regexp_replace(p, '^#[xX][0-9a-fA-F]+;?', '') "
            f"WHEN {names}[{name}] IS NOT NULL THEN {names}[{name}] || regexp_replace(p, '^[A-Za-z][A-Za-z0-9]*;?', '') "
            f"ELSE '&' || p END")
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {body}), '')"


def sql_strip_html(x: str) -> str:
    y = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?(-->|\\z)', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<script\\b.*?(</script\\s*>|\\z)', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<style\\b.*?(</style\\s*>|\\z)', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<template\\b[^>]*>.*?</template\\s*>', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<rt\\b[^>]*>.*?</rt\\s*>', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<rp\\b[^>]*>.*?</rp\\s*>', '', 'g')"
    y = f"regexp_replace({y}, '</?[A-Za-z]([^>\"'']|\"[^\"]*\"|''[^'']*'')*>', '', 'g')"
    y = f"regexp_replace({y}, '<(/?[A-Za-z]|!|\\?)[^>]*>', '', 'g')"
    return sql_decode_entities(y)


def sql_normalize_text(x: str) -> str:
    return sql_norm_ws(sql_strip_html(x))


def sql_strip_non_word(x: str) -> str:
    return f"regexp_replace({x}, '[^{W}{WS}]', '', 'g')"


def sql_clean_tokens(x: str) -> str:
    y = f"regexp_replace(lower(coalesce({x}, '')), 'http[^{WS}]+', '', 'g')"
    return sql_strip_non_word(y)


def sql_split_words(x: str) -> str:
    special = "[" + ", ".join(q(w) for w in CONTRACTIONS) + "]"
    parts = f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda t: t <> '')"
    return (f"flatten(list_transform({parts}, lambda t: CASE WHEN list_contains({special}, lower(t)) "
            f"THEN [substr(t, 1, 3), substr(t, 4, 10)] ELSE [t] END))")


def sql_tokenize(x: str) -> str:
    return sql_split_words(sql_clean_tokens(x))


def sql_clean_sentences(x: str) -> str:
    y = f"regexp_replace(lower(coalesce({x}, '')), 'http[^{WS}]+', '', 'g')"
    y = f"replace({y}, chr(10), ' ')"
    return f"regexp_replace({y}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_split_sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]+)[{WS}]+', '\\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^[{WS}]+|[{WS}]+$', '', 'g'))"
    return f"list_filter({parts}, lambda s: s <> '')"


# ---------------------------------------------------------------- fixture CTEs
CTES: dict[str, tuple[str, list[str]]] = {}
RECURSIVE: set[str] = set()


def cte(name: str, sql: str, deps: list[str] | None = None, recursive: bool = False):
    CTES[name] = (sql, deps or [])
    if recursive:
        RECURSIVE.add(name)


cte("articles", f"""
SELECT doc_id AS id, doc_id AS ord, split_part(text, '.', 1) AS title,
       substr(text, length(split_part(text, '.', 1)) + 2) AS summary,
       '{P.URL_PREFIX}' || CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS VARCHAR) AS url,
       TIMESTAMP '{P.EPOCH}' + (doc_id * {P.MINUTES_PER_DOC}) * INTERVAL 1 MINUTE AS published_at,
       source, lang
FROM documents""")

cte("vocab", f"""
SELECT token, count(*) AS df FROM (
  SELECT DISTINCT id, unnest(string_split_regex(lower({sql_text()}), '[^\\p{{L}}\\p{{N}}_]+')) AS token
  FROM articles) v
WHERE token <> '' GROUP BY token""", ["articles"])

cte("ranked", f"""
SELECT token, df, row_number() OVER (ORDER BY df DESC, token) AS rank FROM vocab
QUALIFY rank <= {P.VOCAB_TOP}""", ["vocab"])

cte("stopwords", f"SELECT token AS word FROM ranked WHERE rank <= {P.STOP_LAST}", ["ranked"])

cte("lexicon", f"""
SELECT token AS word, CAST(rank % 11 - 5 AS DOUBLE) AS weight FROM ranked
WHERE rank > {P.STOP_LAST} AND length(token) >= 3""", ["ranked"])

cte("positive", "SELECT word, weight FROM lexicon WHERE weight > 0", ["lexicon"])
cte("negative", "SELECT word, weight FROM lexicon WHERE weight < 0", ["lexicon"])

cte("stem_map", """
SELECT token, substr(token, 1, length(token) - 1) AS stem FROM vocab
WHERE suffix(token, 's') AND length(token) >= 4""", ["vocab"])

_groups = "[" + ", ".join(q(g) for g in P.GAZ_GROUPS) + "]"
cte("gazetteer", f"""
SELECT token AS word, {_groups}[rank % {len(P.GAZ_GROUPS)} + 1] AS entity_group,
       0.5 + (rank % 5) / 8.0 AS score
FROM (SELECT token, rank FROM ranked WHERE rank BETWEEN {P.GAZ_FIRST} AND {P.GAZ_LAST} AND length(token) >= 4
      UNION ALL SELECT a.token || ' ' || b.token, a.rank FROM ranked a JOIN ranked b ON b.rank = a.rank + 1
      WHERE a.rank <= {P.NAME_PAIRS}) x""", ["ranked"])

cte("entity", f"""
SELECT token AS entity FROM ranked
WHERE rank BETWEEN {P.GAZ_FIRST} AND {P.GAZ_LAST} AND length(token) >= 4
ORDER BY rank LIMIT 1""", ["ranked"])

# N1a in relational form: token spans by a running sum, n-grams by a range
# self-join, containment by NOT EXISTS.
cte("gaz", f"""
SELECT key, arg_max(entity_group, (score, entity_group)) AS entity_group, max(score) AS score,
       len(regexp_extract_all(key, '[{W}]+')) AS ntok
FROM (SELECT lower(word) AS key, entity_group, CAST(score AS DOUBLE) AS score FROM gazetteer) g
GROUP BY key""", ["gazetteer"])

cte("ner_text", f"""
SELECT id, {sql_text()} AS text FROM articles""", ["articles"])

cte("ner_pieces", f"""
SELECT id, unnest(regexp_extract_all(text, '[^{W}]*[{W}]+')) AS piece,
       unnest(generate_series(1, len(regexp_extract_all(text, '[^{W}]*[{W}]+')))) AS pos
FROM ner_text""", ["ner_text"])

cte("ner_spans", f"""
SELECT id, pos, e - length(regexp_extract(piece, '[{W}]+$')) AS s, e FROM (
  SELECT id, pos, piece, CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS e FROM ner_pieces) x""",
    ["ner_pieces"])

cte("ner_hits", """
SELECT a.id AS article_id, a.s AS start_char, b.e AS end_char,
       substr(t.text, a.s + 1, b.e - a.s) AS word
FROM ner_spans a
JOIN ner_spans b ON a.id = b.id AND b.pos >= a.pos AND b.pos < a.pos + (SELECT max(ntok) FROM gaz)
JOIN ner_text t ON t.id = a.id""", ["ner_spans", "gaz", "ner_text"])

cte("ner_matched", """
SELECT h.article_id, h.start_char, h.end_char, h.word, g.entity_group, g.score
FROM ner_hits h JOIN gaz g ON lower(h.word) = g.key""", ["ner_hits", "gaz"])

cte("tagged", f"""
SELECT h.article_id, '{P.GAZETTEER_METHOD}' AS method_name, h.entity_group, h.word, h.score,
       CAST(h.start_char AS INTEGER) AS start_char, CAST(h.end_char AS INTEGER) AS end_char
FROM ner_matched h
WHERE NOT EXISTS (SELECT 1 FROM ner_matched o WHERE o.article_id = h.article_id
                  AND o.start_char <= h.start_char AND o.end_char >= h.end_char
                  AND o.end_char - o.start_char > h.end_char - h.start_char)""", ["ner_matched"])

cte("mentions", f"""
SELECT article_id, method_name, entity_group,
       CASE WHEN length(word) >= {P.SUBWORD_MIN_LEN} THEN '##' || word ELSE word END AS word,
       score, start_char, end_char
FROM tagged""", ["tagged"])


def _sent_cte(name: str, text_sql: str, method: str):
    cte(f"{name}_tok", f"""
SELECT id, unnest({sql_tokenize(text_sql)}) AS tok FROM articles""", ["articles"])
    cte(f"{name}_stem", f"""
SELECT k.id, coalesce(m.stem, k.tok) AS tok
FROM {name}_tok k LEFT JOIN stem_map m ON k.tok = m.token
WHERE k.tok NOT IN (SELECT word FROM stopwords)""", [f"{name}_tok", "stem_map", "stopwords"])
    cte(f"{name}_raw", f"""
SELECT a.id AS article_id,
       CAST(coalesce(sum(coalesce(p.weight, 0) + coalesce(n.weight, 0)), 0) AS DOUBLE) AS raw_score
FROM articles a LEFT JOIN {name}_stem s ON s.id = a.id
LEFT JOIN positive p ON p.word = s.tok LEFT JOIN negative n ON n.word = s.tok
GROUP BY a.id""", [f"{name}_stem", "positive", "negative", "articles"])
    cte(name, f"""
SELECT article_id, '{method}' AS method_name,
       CASE WHEN raw_score > 0 THEN 1.0 WHEN raw_score < 0 THEN -1.0 ELSE 0.0 END AS polarity,
       0.0 AS subjectivity,
       CASE WHEN raw_score > 0 THEN 'positive' WHEN raw_score < 0 THEN 'negative' ELSE 'neutral' END AS label,
       raw_score AS score
FROM {name}_raw""", [f"{name}_raw"])


_sent_cte("sentiment_main", sql_text(), "inset")
_sent_cte("sentiment_title", "title", P.TITLE_METHOD)
cte("sentiments", "SELECT * FROM sentiment_main UNION ALL SELECT * FROM sentiment_title",
    ["sentiment_main", "sentiment_title"])


def with_ctes(final_sql: str, needs: list[str]) -> str:
    """Prefix ``final_sql`` with the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final_sql
    body = ",\n".join(f"{n} AS ({CTES[n][0].strip()})" for n in order)
    kw = "WITH RECURSIVE" if RECURSIVE.intersection(order) else "WITH"
    return f"{kw} {body}\n{final_sql}"
