"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from narrascope.llm import mixing, url_tree

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fill(name: str, kids: str, parent: list[str], child: str) -> str:
    """CTEs that fill each parent's budget ``b`` into its children by weight ``w`` up to ``cap``."""
    p = ", ".join(parent)
    return f"""
{name}_o AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY {p} ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w ELSE 'infinity'::DOUBLE END, {child}
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (PARTITION BY {p}) - coalesce(sum(w) OVER (PARTITION BY {p} ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w ELSE 'infinity'::DOUBLE END, {child}
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM ({kids})),
{name}_f AS (SELECT *, w > 0 AND (b - cap_before) * w >= cap * w_rest AS is_full FROM {name}_o),
{name} AS (
  SELECT *, CASE WHEN is_full THEN cap
                 WHEN sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {p}) > 0
                 THEN (w * (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {p})))
                      // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {p})
                 ELSE 0 END AS alloc
  FROM {name}_f)"""


def _weight(level: str) -> str:
    w = mixing.WEIGHTS.get(level, {})
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END" if w else "1"


def mix_sql(permille: int, max_epochs: int) -> str:
    names = "[" + ", ".join(f"'{d}'" for d in mixing.DOMAINS) + "]"
    return f"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
         CASE WHEN regexp_matches(source, '^src([0-9]{{1,9}})$')
              THEN {names}[(substr(source, 4)::BIGINT % {len(mixing.DOMAINS)}) + 1] ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS tokens, md5(coalesce(text, '')) AS salt
  FROM documents),
leaves AS (SELECT domain, lang, source, count(*) AS n, sum(tokens)::HUGEINT AS supply FROM d GROUP BY ALL),
caps AS (SELECT *, supply * {max_epochs} AS cap, {_weight("domain")} AS w1, {_weight("lang")} AS w2, {_weight("source")} AS w3 FROM leaves),
{_fill("f1", f"SELECT 0 AS root, domain, w1 AS w, sum(cap)::HUGEINT AS cap, (SELECT (sum(supply) * {permille}) // 1000 FROM leaves) AS b FROM caps GROUP BY domain, w1", ["root"], "domain")},
{_fill("f2", "SELECT domain, lang, w2 AS w, sum(caps.cap)::HUGEINT AS cap, any_value(f1.alloc) AS b FROM caps JOIN f1 USING (domain) GROUP BY domain, lang, w2", ["domain"], "lang")},
{_fill("f3", "SELECT caps.domain, caps.lang, source, w3 AS w, caps.cap, f2.alloc AS b FROM caps JOIN f2 ON f2.domain = caps.domain AND f2.lang = caps.lang", ["domain", "lang"], "source")},
plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END AS epochs,
                alloc - (CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END) * supply AS rest
         FROM leaves JOIN f3 USING (domain, lang, source)),
ranked AS (
  SELECT d.*, epochs, rest, ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', epochs::VARCHAR, coalesce(doc_id::VARCHAR, '(null)'), salt)), 1, 15))::BIGINT AS h
  FROM d JOIN plan USING (domain, lang, source)),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) <= rest AS inside FROM ranked),
last AS (SELECT *, CASE WHEN inside THEN epochs ELSE epochs - 1 END AS last_epoch FROM cum)
SELECT doc_id, lang0 AS lang, source0 AS source, domain AS mix_domain, tokens AS mix_tokens, g.e::INTEGER AS mix_epoch
FROM last, unnest(range(0, (last_epoch + 1)::BIGINT)) AS g(e)
"""


WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""

DECONTAM = rf"""
WITH w AS (
  SELECT 'd' AS t, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{AZ}', '{az}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{AZ}', '{az}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
item AS (
  SELECT DISTINCT id AS item_id, least(10, len(ws)) AS len, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS r(i) WHERE t = 'b' AND len(ws) > 0),
lens AS (SELECT DISTINCT len FROM item),
doc AS (
  SELECT id AS doc_id, l.len, i, array_to_string(ws[i:i + l.len - 1], ' ') AS g
  FROM w, lens l, unnest(range(1, len(ws) - l.len + 2)) AS r(i) WHERE t = 'd'),
hit AS (SELECT doc_id, i, doc.len, item_id FROM doc JOIN item ON item.len = doc.len AND item.g = doc.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + len)) AS r(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON pos.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE t = 'd'
"""

LINES = f"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line, trim(translate(s[i], '{AZ}', '{az}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



PHRASES = rf"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(string_split_regex(translate(coalesce(text, ''), '{AZ}', '{az}'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pc),
tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, len, ws[i:i + len - 1] AS p FROM w, unnest(range(1, 6)) AS l(len), unnest(range(1, len(ws) - len + 2)) AS r(i)),
f AS (SELECT lang, len, array_to_string(p, ' ') AS p, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.*, string_split(p, ' ') AS ws FROM f WHERE len > 1),
cut AS (SELECT c.lang, c.p, c.len, c.a, k, l.a AS l, r.a AS r, tot.n, (1000::HUGEINT * c.a * tot.n) // (l.a::HUGEINT * r.a) AS score
        FROM c JOIN tot USING (lang), unnest(range(1, c.len)) AS q(k)
        JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.ws[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS p, c.a
           FROM c, unnest(range(2, c.len)) AS q(m), unnest(range(1, c.len - m + 2)) AS r(i)),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = best.lang AND inside.p = best.p AND 100 * inside.a >= 100 * best.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def _repair_sql() -> str:
    """The edits by a fold over a conversation's rows: per pattern state, cost (8 digits) and audit in one string."""
    add = lambda x, cost, letter: f"(lpad((left({x}, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{letter}')"
    t = "CASE WHEN x[2] = 't' THEN 1 ELSE 0 END"
    live = lambda cond, e: f"CASE WHEN x[2] NOT IN ('b', 'd') AND {cond} THEN {e} ELSE '99999999' END"
    keep = lambda role, *olds: [live(f"x[1] = '{role}'", add(o, t, "K")) for o in olds]
    rerole = lambda *olds: [live("true", add(o, f"2 + {t}", "R")) for o in olds]
    least = lambda *xs: f"least({', '.join(xs)})"
    closed = lambda c: [f"{c}[1]", f"{c}[2]", least(f"{c}[3]", *[add(f"{c}[{k}]", 2, "I") for k in (1, 2, 4)]),
                        least(f"{c}[4]", add(f"{c}[3]", 2, "I"), add(f"{c}[1]", 4, "II"), add(f"{c}[2]", 4, "II"))]
    c = [f"c[{k}]" for k in (1, 2, 3, 4)]
    row = [add(c[0], 3, "D"), least(add(c[1], 3, "D"), *keep("s", c[0])),
           least(add(c[2], 3, "D"), *keep("u", c[0], c[1], c[3]), *rerole(c[0], c[1], c[3])), least(add(c[3], 3, "D"), *keep("a", c[2]), *rerole(c[2]))]
    step = f"list_transform([[{', '.join(closed('acc'))}]], lambda c: [{', '.join(row)}])[1]"
    end = closed("acc")
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS tab),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT c.*, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]),
                                  4294967295::BIGINT), 4294967295) % 20 AS rule FROM c, t),
d AS (SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role,
             CASE rule WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM h, unnest(range(CASE rule WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(n)),
o AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS tie, left(role, 1) AS r,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie) AS i FROM o),
f AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN right(e, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
             lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM s),
g AS (SELECT conv_id, list([r, fault] ORDER BY i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
q AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda acc, x: {step}, ['00000000', '90000000', '90000000', '90000000']) AS acc FROM g),
b AS (SELECT * EXCLUDE (acc), least({end[0]}, {end[3]}) AS best FROM q),
a AS (SELECT *, left(best, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM b),
l AS (SELECT conv_id, j, audit[j] AS x, (length(audit) - length(replace(audit, 'D', ''))) AS dels, length(audit) AS n FROM a, unnest(range(1, length(audit) + 1)) AS r(j)),
m AS (SELECT *, count(*) FILTER (x <> 'I') OVER w AS i, count(*) FILTER (x <> 'D') OVER w - 1 - (n - dels) % 2 AS place
      FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
z AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN f.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END
                                          || ':' || CASE WHEN x = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j)) AS sha
      FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE x <> 'D' GROUP BY m.conv_id)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM v.conv_id
"""


SQL = {"op1_url_tree": url_tree.SQL, "op4_mix": mix_sql(900, 2), "op8_warc": WARC, "op9_decontaminate": DECONTAM, "op10_line_dedup": LINES,
       "op11_conversation_repair": _repair_sql(), "op12_collocations": PHRASES}
