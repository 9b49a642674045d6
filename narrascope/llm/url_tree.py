"""URL filter: a path-template tree per host, judged by smoothed labelled purity (DataFrame functions only).

1. Paths become segments; digit runs and long hexadecimal names become classes (``<n>``, ``<h>``).
   Rows are counted per (host, segments) at once, so everything after works on distinct shapes.
2. Under each (host, prefix) a segment seen in under ``MIN_SHARE`` of the prefix's urls, or under
   ``MIN_SUPPORT`` urls, is variable: it becomes ``*``.
3. Sibling branches are merged where they are statistically alike: literal branches with the same
   most frequent continuation form a pool, and a branch is compared with its pool, by the total
   variation between their distributions over what follows and by their labelled rates. If neither
   differs by more than sampling would explain, it becomes ``{*}``. A branch or pool without labels has no
   rate to compare and is judged by its continuations alone, so that the merged template carries the labels
   of its alike siblings. Each branch meets only its pool, never its siblings one by one.
4. A template is rejected if its smoothed purity reaches ``REJECT``. Purity is the blocked share of its labelled
   urls, ``(blocked + ALPHA * h) / (labelled + ALPHA)``; ``h`` is the same share over its host, smoothed likewise
   towards that of its literal templates (those before merging) on all hosts, and that one towards the share of
   all labelled urls.

Labels come from rules: a url that a rule fits has the rule's verdict and counts as labelled; the tree
judges the rest. Paths of any depth are taken whole: a prefix or a rest is known by a 128-bit key, the XOR of
the hashes of its (position, segment) pairs, so a path costs its length and no prefix is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.common import ascii_lower, materialize

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MIN_SUPPORT = 5
MIN_SHARE_PERCENT = 1
MAX_VARIATION = 0.1
MAX_RATE_GAP = 0.1
ALPHA = 5
REJECT = 0.8
SALT = 16  # parts over which the rows of one host or template are dealt when they meet its sums
UNIT = 1_000_000_000  # distributions are summed as whole billionths, so sums do not depend on their order


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty for a null url or one without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host or a subdomain, path prefix), as text, and its verdict; else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = path.startswith(p) & ((host == h) | host.endswith("." + h))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """The path's segments with variable text classed, as one string; empty segments do not count."""
    return F.array_join(F.transform(_segments(path), lambda s: F.when(s.rlike("^[0-9A-Fa-f-]{8,}$") & s.rlike("[0-9]"), F.lit("<h>"))
                                    .otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))), "/")


def _segments(c) -> Column:
    return F.filter(F.split(c, "/"), lambda s: s != "")


def _key(pos: Column, tok: Column) -> Column:
    return F.struct(F.xxhash64(pos, tok).alias("a"), F.xxhash64(tok, pos, F.lit(1)).alias("b"))


def _xor(x: Column, y: Column) -> Column:
    return F.struct(x["a"].bitwiseXOR(y["a"]).alias("a"), x["b"].bitwiseXOR(y["b"]).alias("b"))


def _exploded(rows: DataFrame, col: str, *carry: str) -> DataFrame:
    """One row per segment of ``col``: its position, and the keys of the prefix before it and of the rest after it."""
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    seg = rows.select("host", "id", *carry, _segments(col).alias("segs"))
    seg = seg.withColumn("whole", F.aggregate(F.transform("segs", lambda s, i: _key(i, s)), zero, _xor))
    out = seg.select("host", "id", *carry, "whole", F.posexplode("segs").alias("pos", "tok")).withColumn("key", _key(F.col("pos"), F.col("tok")))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("upto", F.struct(*[F.bit_xor(F.col("key")[c]).over(so_far).alias(c) for c in "ab"]))
    return out.select("host", "id", *carry, "pos", "tok", _xor(F.col("upto"), F.col("key")).alias("prefix"),
                      _xor(F.col("whole"), F.col("upto")).alias("rest"))


def _rebuilt(rows: DataFrame, labelled: DataFrame, new: str) -> DataFrame:
    """``rows`` with ``new``: the labels of all segments put together again."""
    joined = labelled.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("s"))
    joined = joined.select("id", F.array_join(F.transform("s", lambda x: x["label"]), "/").alias(new))
    return rows.join(joined, "id", "left").withColumn(new, F.coalesce(new, F.lit("")))


def generalise(shapes: DataFrame) -> DataFrame:
    """``shapes`` (with ``id``) with ``template``: segments that are rare under their prefix as ``*``."""
    e = materialize(_exploded(shapes, "shape", "n").drop("rest"), "url-segments")
    at = ["host", "pos", "prefix"]
    tokens = e.groupBy(*at, "tok").agg(F.sum("n").alias("n_tok"))
    total = e.groupBy(*at).agg(F.sum("n").alias("n_all"))
    kept = (F.col("n_tok") >= MIN_SUPPORT) & (F.col("n_tok") * 100 >= F.col("n_all") * MIN_SHARE_PERCENT)
    named = tokens.join(total, at).select(*at, "tok", F.when(kept, F.col("tok")).otherwise("*").alias("label"))
    return _rebuilt(shapes, e.join(named, [*at, "tok"]), "template")


def merge_branches(templates: DataFrame) -> DataFrame:
    """``templates`` (id, host, template, n, labelled, blocked) with ``merged``: alike sibling branches as ``{*}``.

    ``id`` must follow the order of the templates of a host: of equally frequent continuations the last one counts.
    """
    e = materialize(_exploded(templates, "template", "n", "labelled", "blocked"), "url-branches")
    literal = e.filter((F.col("tok") != "*") & ~F.contains("tok", F.lit("<")))
    branch = ["host", "pos", "prefix", "tok"]
    suffix = literal.groupBy(*branch, "rest").agg(F.sum("n").alias("n_bs"), F.max("id").alias("last"))
    of_branch = (literal.groupBy(*branch).agg(F.sum("n").alias("n_b"), F.sum("labelled").alias("lab_b"), F.sum("blocked").alias("blk_b"))
                 .join(suffix.groupBy(*branch).agg(F.max(F.struct("n_bs", "last", "rest"))["rest"].alias("mode")), branch))
    parent = ["host", "pos", "prefix", "mode"]
    suffix = suffix.join(of_branch, branch)
    pool_suffix = suffix.groupBy(*parent, "rest").agg(F.sum("n_bs").alias("n_s"))
    kinds = pool_suffix.groupBy(*parent).agg(F.count(F.lit(1)).alias("k"))
    pool = of_branch.groupBy(*parent).agg(F.sum("n_b").alias("n_all"), F.sum("lab_b").alias("lab"), F.sum("blk_b").alias("blk"))
    p, q = F.col("n_bs") / F.col("n_b"), F.col("n_s") / F.col("n_all")
    gap = F.round((F.abs(p - q) - q) * UNIT).cast("long")
    facts = (suffix.join(pool_suffix, [*parent, "rest"]).join(pool, parent)
             .groupBy(*branch, "mode").agg((F.sum(gap) + UNIT).alias("gap"), *[F.first(c).alias(c) for c in ("n_b", "lab_b", "blk_b", "lab", "blk")])
             .join(kinds, parent))
    variation = F.col("gap") / (2.0 * UNIT)
    rate = F.try_divide("blk", "lab")
    same_rate = F.abs(F.try_divide("blk_b", "lab_b") - rate) <= MAX_RATE_GAP + 2 * F.sqrt(F.try_divide(rate * (1 - rate), "lab_b"))
    alike = (variation <= MAX_VARIATION + F.sqrt(F.col("k") / F.col("n_b")) / 2) & F.coalesce(same_rate, F.lit(True))
    judged = facts.filter(alike).select(*branch, "mode")
    several = judged.groupBy(*parent).agg(F.count(F.lit(1)).alias("n_alike")).filter("n_alike > 1")
    merged = judged.join(several, parent, "left_semi").select(*branch, F.lit("{*}").alias("one"))
    labelled = e.join(merged, branch, "left").withColumn("label", F.coalesce("one", "tok"))
    return _rebuilt(templates, labelled, "merged")


def _meet(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to the one row of ``sums`` for their ``key``; rows of a frequent key are dealt over copies of it."""
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("host", "template"), F.lit(SALT)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def purities(merged: DataFrame) -> DataFrame:
    """``host, merged, purity`` of every merged template, smoothed towards host, its literal templates anywhere, all urls."""
    share = merged.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("r")).first()["r"]
    on_host = merged.groupBy("host").agg(F.sum("labelled").alias("lab_h"), F.sum("blocked").alias("blk_h"))
    anywhere = merged.groupBy("template").agg(F.sum("labelled").alias("lab_t"), F.sum("blocked").alias("blk_t"))
    met = _meet(_meet(merged, on_host, "host"), anywhere, "template")
    own = met.groupBy("host", "merged", "lab_h", "blk_h").agg(*[F.sum(c).alias(c) for c in ("labelled", "blocked", "lab_t", "blk_t")])
    smooth = lambda blocked, labelled, prior: (F.col(blocked) + ALPHA * prior) / (F.col(labelled) + ALPHA)
    purity = smooth("blocked", "labelled", smooth("blk_h", "lab_h", smooth("blk_t", "lab_t", F.lit(float(share)))))
    return own.select("host", "merged", F.round(purity, 6).alias("purity"))


def op1_url_tree(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row of ``pages``.

    A url without host or path has the template of an empty path, which is judged like any other template;
    without any label at all the blocked share counts as 0. Repeated rows are all returned, very long and deep
    paths are taken whole, equally frequent continuations go to the last in byte order, and columns other than
    ``page_id`` and ``url`` are not looked at.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("rule_verdict", verdict).withColumn("shape", shape(F.col("path")))
    shapes = materialize(urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("rule").alias("labelled"),
        F.sum((F.coalesce("rule_verdict", F.lit("")) == "block").cast("long")).alias("blocked")).withColumn("id", F.monotonically_increasing_id()), "url-shapes")
    shapes = materialize(generalise(shapes), "url-templates")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    templates = shapes.groupBy("host", "template").agg(*sums).orderBy("host", "template")
    templates = materialize(templates.withColumn("id", F.monotonically_increasing_id()), "url-tree")
    merged = materialize(merge_branches(templates), "url-merged")
    judged = materialize(shapes.select("host", "shape", "template").join(merged.select("host", "template", "merged"), ["host", "template"])
                         .join(purities(merged), ["host", "merged"]).select("host", "shape", F.col("merged").alias("template"), "purity"), "url-verdicts")
    tree = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", tree).alias("verdict"), "template", "purity")


SQL = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages),
rules(rv, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
r AS (
  SELECT u.*, (SELECT max(struct_pack(l := length(rh || rp), rule := rh || rp, rv := rv)) FROM rules
               WHERE starts_with(path, rp) AND (host = rh OR ends_with(host, '.' || rh))) AS best,
         array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
           lambda x: CASE WHEN regexp_matches(x, '^[0-9A-Fa-f-]{{8,}}$') AND regexp_matches(x, '[0-9]') THEN '<h>'
                ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END), '/') AS shape
  FROM u),
shapes AS (
  SELECT host, shape, count(*) AS n, count(best) AS labelled, sum(CASE WHEN best.rv = 'block' THEN 1 ELSE 0 END)::BIGINT AS blocked
  FROM r GROUP BY ALL),
e AS (
  SELECT host, shape, n, pos, segs[pos] AS tok, array_to_string(segs[1:pos - 1], '/') AS prefix
  FROM (SELECT *, list_filter(string_split(shape, '/'), lambda x: x <> '') AS segs FROM shapes) s, unnest(range(1, len(segs) + 1)) AS g(pos)),
named AS (
  SELECT host, prefix, tok, CASE WHEN sum(n) >= {MIN_SUPPORT} AND sum(n) * 100 >= sum(sum(n)) OVER (PARTITION BY host, prefix) * {MIN_SHARE_PERCENT}
                            THEN tok ELSE '*' END AS label
  FROM e GROUP BY host, prefix, tok),
shaped AS (
  SELECT s.*, coalesce(t.template, '') AS template FROM shapes s LEFT JOIN (
    SELECT host, shape, string_agg(label, '/' ORDER BY pos) AS template FROM e JOIN named USING (host, prefix, tok) GROUP BY ALL) t USING (host, shape)),
templates AS (SELECT host, template, sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM shaped GROUP BY ALL),
b AS (
  SELECT host, template, n, labelled, blocked, pos, segs[pos] AS tok, array_to_string(segs[1:pos - 1], '/') AS prefix,
         array_to_string(segs[pos + 1:], '/') AS rest
  FROM (SELECT *, list_filter(string_split(template, '/'), lambda x: x <> '') AS segs FROM templates) s, unnest(range(1, len(segs) + 1)) AS g(pos)),
lit AS (SELECT * FROM b WHERE tok <> '*' AND NOT contains(tok, '<')),
suffix AS (SELECT host, prefix, tok, rest, sum(n)::BIGINT AS n_bs FROM lit GROUP BY ALL),
br AS (SELECT host, prefix, tok, sum(n)::BIGINT AS n_b, sum(labelled)::BIGINT AS lab_b, sum(blocked)::BIGINT AS blk_b FROM lit GROUP BY ALL),
modes AS (SELECT host, prefix, tok, max(struct_pack(n := n_bs, rest := rest)).rest AS mode FROM suffix GROUP BY ALL),
sm AS (SELECT * FROM suffix JOIN br USING (host, prefix, tok) JOIN modes USING (host, prefix, tok)),
ps AS (SELECT host, prefix, mode, rest, sum(n_bs)::BIGINT AS n_s FROM sm GROUP BY ALL),
pool AS (SELECT host, prefix, mode, sum(n_b)::BIGINT AS n_all, sum(lab_b)::BIGINT AS lab, sum(blk_b)::BIGINT AS blk FROM br JOIN modes USING (host, prefix, tok) GROUP BY ALL),
kinds AS (SELECT host, prefix, mode, count(*) AS k FROM ps GROUP BY ALL),
facts AS (
  SELECT host, prefix, mode, tok, n_b, lab_b, blk_b, lab, blk, k,
         sum(round((abs(n_bs / n_b - n_s / n_all) - n_s / n_all) * {UNIT})::BIGINT)::BIGINT + {UNIT} AS gap
  FROM sm JOIN ps USING (host, prefix, mode, rest) JOIN pool USING (host, prefix, mode) JOIN kinds USING (host, prefix, mode)
  GROUP BY ALL),
alike AS (
  SELECT *, count(*) OVER (PARTITION BY host, prefix, mode) AS n_alike FROM facts
  WHERE gap / {2.0 * UNIT:.1f}::DOUBLE <= {MAX_VARIATION}::DOUBLE + sqrt(k / n_b) / 2
    AND (lab_b = 0 OR abs(blk_b / nullif(lab_b, 0) - blk / nullif(lab, 0))
                      <= {MAX_RATE_GAP}::DOUBLE + 2 * sqrt((blk / nullif(lab, 0)) * (1 - blk / nullif(lab, 0)) / nullif(lab_b, 0)))),
merged AS (
  SELECT t.*, coalesce(m.merged, '') AS merged FROM templates t LEFT JOIN (
    SELECT b.host, b.template, string_agg(CASE WHEN a.n_alike > 1 THEN '{{*}}' ELSE b.tok END, '/' ORDER BY b.pos) AS merged
    FROM b LEFT JOIN alike a ON a.host = b.host AND a.prefix = b.prefix AND a.tok = b.tok GROUP BY ALL) m USING (host, template)),
on_host AS (SELECT host, sum(blocked)::BIGINT AS blk_h, sum(labelled)::BIGINT AS lab_h FROM merged GROUP BY ALL),
anywhere AS (SELECT template, sum(blocked)::BIGINT AS blk_t, sum(labelled)::BIGINT AS lab_t FROM merged GROUP BY ALL),
own AS (SELECT host, merged, sum(blocked)::BIGINT AS blk, sum(labelled)::BIGINT AS lab, sum(blk_t)::BIGINT AS blk_t, sum(lab_t)::BIGINT AS lab_t
        FROM merged JOIN anywhere USING (template) GROUP BY ALL),
share AS (SELECT coalesce(sum(blk) / nullif(sum(lab), 0), 0)::DOUBLE AS r FROM own),
final AS (
  SELECT host, merged, round((blk + {ALPHA} * ((blk_h + {ALPHA} * ((blk_t + {ALPHA} * r) / (lab_t + {ALPHA}))) / (lab_h + {ALPHA}))) / (lab + {ALPHA}), 6) AS purity
  FROM own JOIN on_host USING (host), share)
SELECT page_id, r.host, path, best.rule AS rule, coalesce(best.rv, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       merged AS template, purity
FROM r JOIN shaped USING (host, shape) JOIN merged USING (host, template) JOIN final USING (host, merged)
"""
