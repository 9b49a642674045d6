"""Entity framing phrases.

The targets are grouped per article first (bounded by the mentions of one
article), so the article text travels through the join with them once, not once per
entity. A row per sentence follows; only sentences that hold a target's word are
tokenised, and an occurrence takes along the few tokens around it, never its
sentence. F9 gathers an article's candidates again by (article, entity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.functions.arrays import bind_value
from narrascope.operators.util import cut_lineage, join_on_hot_key, spread

WINDOW = 7
METHOD = "ngram_window"
MIN_TOKENS, MAX_TOKENS, EDGE_TOKENS = 2, 8, 6
#: a stopword list of up to this many words travels as a literal; a longer one is joined
LITERAL_WORDS = 4096
#: distinct phrases of one article and entity that are compared inside the row; more are split over tasks
ROW_PHRASES = 64
#: entries that share a prefix and are sorted in one task; more are split by a longer prefix
GROUP_ROWS = 200_000
#: characters that an entry of F11 holds at first, and positions that one regex pass lists
CAP, PIECE = 128, 4096
_ENT = "\u0001"
_SEP = "\u0002"


def _empty_str_array() -> Column:
    return F.array().cast("array<string>")


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (which returns an array)."""
    return F.flatten(F.transform(F.array(value), body))


def _with_stops(sentences: DataFrame, stopwords: DataFrame) -> DataFrame:
    """``sentences`` with ``stops``, the distinct stopwords among the tokens ``t`` of a sentence."""
    words = stopwords.select(F.lower(F.trim("word")).alias("w")).where("w <> ''").distinct()
    listed = [r[0] for r in words.limit(LITERAL_WORDS + 1).collect()]
    if len(listed) <= LITERAL_WORDS:
        return sentences.withColumn("stops", F.array_intersect("t", F.lit(sorted(listed)).cast("array<string>")))
    rows = cut_lineage(sentences.withColumn("_sent", F.monotonically_increasing_id()))
    own = join_on_hot_key(rows.select("_sent", F.explode(F.array_distinct("t")).alias("w")), words, "w", "left_semi")
    own = own.groupBy("_sent").agg(F.collect_set("w").alias("stops"))
    return rows.join(own, "_sent", "left").withColumn("stops", F.coalesce("stops", _empty_str_array())).drop("_sent")


def with_sentences(articles: DataFrame, stopwords: DataFrame, keep: list[str]) -> DataFrame:
    """F0 + F1: a row per (sentence, entity whose lowered word and first token it holds) of ``text`` and ``ents`` (array of entity words).

    Output: ``keep``, ``sent_idx``, ``t`` (tokens of the sentence), ``stops`` (its stopwords), ``entity_word`` and ``etoks``. A sentence
    that holds no entity's word is left before it is cut into tokens, and no row holds more than one sentence.
    """
    ents = F.transform("ents", lambda e: F.struct(e.alias("word"), F.lower(e).alias("low"), entity_tokens(e).alias("etoks")))
    a = articles.select(*keep, "text", ents.alias("_ents"))
    s = a.select(*keep, "_ents", F.posexplode(X.split_sentences(X.clean_for_sentences(F.col("text")))).alias("sent_idx", "s"))
    # one generated row at most, as a filter on ``_own`` would compute it and the tokens twice
    own = lambda t, held: F.filter(held, lambda e: F.array_contains(t, F.get(e["etoks"], F.lit(0))))
    row = lambda t, own: F.when(F.size(own) > 0, F.array(F.struct(t.alias("t"), own.alias("own"))))
    tokens = lambda held: bind_value(X.word_tokens_lower(F.col("s")), lambda t: bind_value(own(t, held), lambda o: row(t, o)))
    found = bind_value(F.filter("_ents", lambda e: F.contains(F.col("s"), e["low"])), lambda held: F.when(F.size(held) > 0, tokens(held)))
    held = s.select(*keep, "sent_idx", F.explode(found).alias("_h")).select(*keep, "sent_idx", F.col("_h.t").alias("t"), F.col("_h.own").alias("_own"))
    pairs = _with_stops(held, stopwords).select(*keep, "sent_idx", "t", "stops", F.explode(F.concat("_own")).alias("_e"))
    return pairs.select(*keep, "sent_idx", "t", "stops", F.col("_e.word").alias("entity_word"), F.col("_e.etoks").alias("etoks"))


def entity_tokens(entity: Column) -> Column:
    """Lowered, punctuation-free tokens of the entity word."""
    return X.word_tokens_lower(entity)


def occurrence_starts(tokens: Column, etoks: Column) -> Column:
    """1-based starts of every (overlapping) run of ``etoks`` in ``tokens``."""
    n = F.size(etoks)
    last = F.size(tokens) - n + 1
    return F.when((n >= 1) & (last >= 1),
                  F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                           # first token before the slice: most positions allocate nothing
                           lambda i: (F.element_at(tokens, i) == F.element_at(etoks, 1))
                           & (F.slice(tokens, i, n) == etoks))
                  ).otherwise(F.array().cast("array<int>"))


def context_window(tokens: Column, start: Column, n: Column, size: int = WINDOW) -> Column:
    """``size`` tokens each side of the run, clipped to the sentence."""
    lo = F.greatest(F.lit(1), start - size)
    hi = F.least(F.size(tokens), start + n - 1 + size)
    return F.slice(tokens, lo, hi - lo + 1)


def split_segments(window: Column, etoks: Column) -> Column:
    """cut the window at every token of the entity token set; empty segments dropped."""
    marked = F.transform(window, lambda x: F.when(F.array_contains(etoks, x), F.lit(_ENT)).otherwise(x))
    pieces = F.split(F.array_join(marked, _SEP), f"({_SEP}?{_ENT})+{_SEP}?")
    return F.transform(F.filter(pieces, lambda z: z != ""), lambda z: F.split(z, _SEP))


def trim_stopwords(segment: Column, stops: Column) -> Column:
    """drop stopwords at both ends (``stops``: the stopwords among the tokens of the window)."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(segment), F.lit(1))),
                      lambda k: ~F.array_contains(stops, F.coalesce(F.try_element_at(segment, k), F.lit(""))))
    return _bind(places, lambda keep: F.array(F.when((F.size(keep) > 0) & (F.size(segment) > 0), F.slice(
        segment, F.try_element_at(keep, F.lit(1)), F.try_element_at(keep, F.lit(-1)) - F.try_element_at(keep, F.lit(1)) + 1))
        .otherwise(_empty_str_array()))).getItem(0)


def phrase_rule(tokens: Column) -> Column:
    """2-8 tokens whole; more: first 6 and last 6; fewer: none."""
    n = F.size(tokens)
    return (F.when(n.between(MIN_TOKENS, MAX_TOKENS), F.array(F.array_join(tokens, " ")))
            .when(n > MAX_TOKENS, F.array(F.array_join(F.slice(tokens, 1, EDGE_TOKENS), " "),
                                          F.array_join(F.slice(tokens, -EDGE_TOKENS, EDGE_TOKENS), " ")))
            .otherwise(_empty_str_array()))


def maximal_phrases(phrases: Column) -> Column:
    """F8: distinct phrases that are no character substring of another distinct phrase."""
    # only a strictly longer phrase can hold another (equal-length distinct ones cannot),
    # so the cheap length test runs before ``contains``
    return _bind(F.array_distinct(phrases), lambda d: F.filter(
        d, lambda x: ~F.exists(d, lambda y: (F.length(y) > F.length(x)) & y.contains(x))))


def maximal_by_group(rows: DataFrame, keys: list[str], phrases: str) -> DataFrame:
    """F8 for rows of ``keys`` and an array of distinct phrases: one row per maximal phrase.

    Short lists are compared inside the row; a long one (an article that repeats its entity) would be
    quadratic there, so its phrases become rows and are sorted by suffix like the corpus's.
    """
    rows = cut_lineage(rows)
    few = rows.where(F.size(phrases) <= ROW_PHRASES).select(*keys, F.explode(maximal_phrases(F.col(phrases))).alias("phrase"))
    many = rows.where(F.size(phrases) > ROW_PHRASES).select(*keys, F.explode(phrases).alias("phrase"))
    if many.isEmpty():
        return few
    return few.unionByName(corpus_maximal(many, keys=keys))


def frame_entities(articles: DataFrame, targets: DataFrame, stopwords: DataFrame,
                   size: int = WINDOW, id_col: str = "id") -> DataFrame:
    """(article_id, entity_word, framing_phrase, method_name) for every target."""
    out = _row_candidates(_occurrences(_with_targets(articles, targets, id_col), stopwords, ["_row", "article_id"], size),
                          ["article_id", "entity_word"], size)
    return (maximal_by_group(out, ["article_id", "entity_word"], "ph")
            .select("article_id", "entity_word", F.col("phrase").alias("framing_phrase"), F.lit(METHOD).alias("method_name")))


def _with_targets(articles: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """``_row`` (an article's row, as ids may repeat), article_id, text and ``ents``, the entity words of the article."""
    per_article = spread(targets, "article_id").groupBy("article_id").agg(F.collect_set("entity_word").alias("ents"))
    a = articles.select(F.col(id_col).alias("article_id"), X.article_text("title", "summary", ". ").alias("text"))
    return spread(a, "article_id").join(per_article, "article_id").withColumn("_row", F.monotonically_increasing_id())


def _occurrences(texts: DataFrame, stopwords: DataFrame, keep: list[str], size: int) -> DataFrame:
    """F3 rows of ``texts`` (text, ents): ``near`` holds the tokens up to ``size`` from the run, which starts there at ``at``.

    Only these few tokens go on, so a long sentence with many runs is not copied for each of them.
    """
    pairs = with_sentences(texts, stopwords, keep)
    n = F.size("etoks")
    near = lambda i: F.struct(i.alias("start"), F.least(i, F.lit(size + 1)).alias("at"), context_window(F.col("t"), i, n, size).alias("near"))
    found = F.transform(occurrence_starts(F.col("t"), F.col("etoks")), near)
    occ = pairs.select(*keep, "entity_word", "sent_idx", "etoks", "stops", F.explode(found).alias("o"))
    return occ.select(*keep, "entity_word", "sent_idx", "etoks", "o.start", "o.at", "o.near", F.array_intersect("o.near", "stops").alias("stops"))


def _row_candidates(occ: DataFrame, keys: list[str], size: int) -> DataFrame:
    """F4-F7 of the occurrences: ``keys`` and ``ph``, the distinct candidate phrases, per article row and ``keys``."""
    c = candidates(trimmed(segments(windows(occ, size))))
    return c.groupBy("_row", *keys).agg(F.collect_set("phrase").alias("ph")).drop("_row")


# ---------------------------------------------------------------- step views
def occurrences(articles: DataFrame, targets: DataFrame, stopwords: DataFrame,
                id_col: str = "id", size: int = WINDOW) -> DataFrame:
    """F3 rows: (article_id, entity_word, sent_idx, start) plus the tokens around the run for later steps."""
    return _occurrences(_with_targets(articles, targets, id_col).drop("_row"), stopwords, ["article_id"], size)


def windows(occ: DataFrame, size: int = WINDOW) -> DataFrame:
    """F4 rows: ``window`` added to each occurrence (``size`` at most that of the occurrences)."""
    return occ.withColumn("window", context_window(F.col("near"), F.col("at"), F.size("etoks"), size)).drop("near", "at")


def segments(win: DataFrame) -> DataFrame:
    """F5 rows: one per segment (``seg_idx``, ``segment``)."""
    return win.select("*", F.posexplode(split_segments(F.col("window"), F.col("etoks"))).alias("seg_idx", "segment")).drop("window", "etoks")


def trimmed(seg: DataFrame) -> DataFrame:
    """F6 rows: ``trimmed`` segment."""
    return seg.withColumn("trimmed", trim_stopwords(F.col("segment"), F.col("stops"))).drop("segment", "stops")


def candidates(tr: DataFrame) -> DataFrame:
    """F7 rows: one per candidate phrase."""
    return tr.select("*", F.posexplode(phrase_rule(F.col("trimmed"))).alias("cand_idx", "phrase")).drop("trimmed")


# ---------------------------------------------------------------- corpus
def article_phrases_for(articles: DataFrame, entity: str, stopwords: DataFrame,
                        size: int = WINDOW, id_col: str = "id") -> DataFrame:
    """Per article, the maximal phrases for one entity: (article_id, url, phrase), written once."""
    a = articles.select(F.col(id_col).alias("article_id"), "url",
                        X.article_text("title", "summary", ". ").alias("text"))
    # cheap exact gate before any sentence work: every sentence is a piece of
    # the F0-cleaned text, so a sentence holding the entity implies this
    a = a.where(X.clean_for_sentences(F.col("text")).contains(entity.lower()))
    a = a.withColumn("ents", F.array(F.lit(entity))).withColumn("_row", F.monotonically_increasing_id())
    ph = _row_candidates(_occurrences(a, stopwords, ["_row", "article_id", "url"], size), ["article_id", "url"], size)
    return cut_lineage(maximal_by_group(ph, ["article_id", "url"], "ph"))


def _entries(d: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Every position of every phrase (pid, pos, self) with the ``cap`` characters from there, ``s``.

    A phrase is cut into pieces of ``PIECE`` characters that overlap by ``cap``, and one regex pass lists a piece's
    entries, so a phrase costs rows in proportion to its length and no long array.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("p") - 1, F.lit(0)), F.lit(PIECE))
    pieces = d.select(*keys, "pid", "p", F.explode(starts).alias("at"))
    pieces = pieces.select(*keys, "pid", "at", F.when(F.length("p") <= PIECE, F.col("p")).otherwise(F.substring("p", F.col("at") + 1, F.lit(PIECE + cap))).alias("piece"))
    every = F.slice(F.regexp_extract_all("piece", F.lit(f"(?s)(?=(.{{1,{cap}}}))."), F.lit(1)), 1, PIECE)
    listed = pieces.select(*keys, "pid", "at", F.posexplode(F.when(F.col("piece") == "", F.array(F.lit(""))).otherwise(every)).alias("i", "s"))
    return listed.select(*keys, "pid", (F.col("at") + F.col("i")).alias("pos"), "s", ((F.col("at") + F.col("i")) == 0).alias("self"))


def corpus_maximal(phrases: DataFrame, col: str = "phrase", key_len: int = 8, keys: list[str] | None = None,
                   group_rows: int | None = None, cap: int = CAP) -> DataFrame:
    """keep the rows whose phrase is no character substring of another distinct phrase of its group.

    ``keys`` name the group (none: the whole table). Every position of every distinct phrase is an entry that knows
    its phrase by number and holds the next ``cap`` characters, never the rest of the phrase. A phrase lies
    inside another exactly when some other entry starts with it. Entries are handled by prefix length, ``key_len`` first:

    * phrases shorter than that: entries emit their prefixes of the lengths such phrases have, are joined to
      those phrases, and counted (a partial aggregation);
    * phrases shorter than ``cap``: entries with the same prefix are sorted, and the entries starting with a phrase
      follow it directly, so the next one is tested (``lead``);
    * longer phrases: only those whose first ``cap`` characters start another entry too, and only such entries, go
      round again with ``cap`` eight times as long;
    * a prefix shared by more than ``GROUP_ROWS`` entries is not sorted in one task: its entries go round again with
      ``key_len`` doubled. Both lengths are bounded by the longest phrase, so this ends.

    No pair of phrases is ever emitted and no nested-loop join is planned.
    """
    keys = keys or []
    limit = GROUP_ROWS if group_rows is None else group_rows
    cap = max(cap, 2 * key_len)
    same = lambda a, b: [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    other = lambda df, *cols: df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in cols])
    whole = cut_lineage(phrases.select(*keys, F.col(col).alias("p")).distinct().withColumn("pid", F.monotonically_increasing_id()))
    if whole.isEmpty():
        return phrases
    d = whole.select(*keys, "pid", "p", F.length("p").alias("size"))
    suf = _entries(whole, keys, cap)
    inside = []
    while True:
        short = d.where(F.col("size") < key_len)
        lengths = sorted(r[0] for r in short.select("size").distinct().collect())  # at most key_len of them
        if lengths:
            n = F.explode(F.filter(F.lit(lengths), lambda x: x <= F.length("s")))
            pref = suf.select(*keys, n.alias("n"), "s").select(*keys, F.expr("substring(s, 1, n)").alias("p"))
            tagged = other(short, "p")
            hit = pref.join(tagged, [*same(pref, tagged), pref["p"] == tagged["_p"]], "left_semi")
            found = other(hit.groupBy(*keys, "p").agg(F.count("*").alias("c")).where("c > 1"), "p")
            inside.append(short.join(found, [*same(short, found), short["p"] == found["_p"]], "left_semi").select("pid"))
        longs = suf.where(F.length("s") >= key_len).withColumn("key", F.substring("s", 1, key_len))
        big = cut_lineage(longs.groupBy(*keys, "key").agg(F.count("*").alias("c")).where(F.col("c") > limit).drop("c"))
        hot = other(big, "key")
        is_hot = [*same(longs, hot), longs["key"] == hot["_key"]]
        any_hot = not big.isEmpty()
        plain = longs.join(hot, is_hot, "left_anti") if any_hot else longs
        w = Window.partitionBy(*keys, "key").orderBy(F.asc("s"), F.desc("self"))
        flagged = plain.select(*keys, "pid", "s", "self", F.lead("s").over(w).alias("nxt"))
        inside.append(flagged.where(F.col("self") & (F.length("s") < cap) & F.col("nxt").isNotNull()
                                    & (F.substring("nxt", 1, F.length("s")) == F.col("s"))).select("pid"))
        # first cap characters of a longer phrase that start another entry too
        open_ = plain.where(F.length("s") >= cap).groupBy(*keys, "s").agg(F.count("*").alias("c"), F.max("self").alias("own")).where("own and c > 1")
        open_ = cut_lineage(other(open_, "s"))
        any_open = not open_.isEmpty()
        if not any_hot and not any_open:
            break
        parts = [longs.join(hot, is_hot, "left_semi")] if any_hot else []
        if any_open:
            parts.append(plain.join(open_, [*same(plain, open_), plain["s"] == open_["_s"]], "left_semi"))
        left = reduce(DataFrame.unionByName, [x.select("pid", "pos", "self") for x in parts])
        key_len, cap = 2 * key_len, max(8 * cap if any_open else cap, 4 * key_len)
        suf = cut_lineage(left.join(whole, "pid").select(*keys, "pid", "pos", F.substring("p", F.col("pos") + 1, F.lit(cap)).alias("s"), "self"))
        d = suf.where("self").select("pid").join(whole, "pid").select(*keys, "pid", "p", F.length("p").alias("size"))
    gone = other(reduce(DataFrame.unionByName, inside).distinct().join(whole, "pid"), "p")
    return phrases.join(gone, [*same(phrases, gone), phrases[col] == gone["_p"]], "left_anti")


def _counted(ap: DataFrame) -> DataFrame:
    agg = ap.groupBy("phrase").agg(
        F.count("*").alias("count"),
        F.count_distinct(F.when(F.col("url") != "", F.col("url"))).alias("n_sources"))
    return corpus_maximal(cut_lineage(agg)).where(F.col("count") > 1)


def corpus_phrases(articles: DataFrame, entity: str, stopwords: DataFrame, size: int = WINDOW,
                   id_col: str = "id") -> DataFrame:
    """(phrase, count, n_sources) with count > 1, maximal over the corpus first.

    ``count`` = articles yielding the phrase, ``n_sources`` = distinct non-empty
    URLs; the URL list itself is ``corpus_phrase_sources`` (one row per pair,
    never one unbounded array per phrase).
    """
    ap = article_phrases_for(articles, entity, stopwords, size, id_col)
    return _counted(ap).orderBy(F.desc("count"), F.asc("phrase"))


def corpus_phrase_sources(articles: DataFrame, entity: str, stopwords: DataFrame, size: int = WINDOW,
                          id_col: str = "id") -> DataFrame:
    """F10 sources: distinct (phrase, url) of the phrases kept by ``corpus_phrases``."""
    ap = article_phrases_for(articles, entity, stopwords, size, id_col)
    return (ap.where(F.col("url").isNotNull() & (F.col("url") != ""))
            .join(_counted(ap).select("phrase"), "phrase", "left_semi").select("phrase", "url").distinct())
