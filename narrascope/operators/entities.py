"""Entity mentions.

N1a tags mentions by a gazetteer table. A text is cut into chunks of ``CHUNK_TOKENS`` tokens that know where they start, and each
token of a chunk is one row; the place of a token is counted inside its chunk, and only once it begins a name. The join is on the first token of a name (broadcast if the table is measured to be small, else
with hot tokens spread), so only tokens that begin some name survive. Names of three tokens or more are
met by their first two; only the articles that hold such a pair are read again, and only the places of the
pair take as many tokens as the longest name that begins with it has, so one long name widens no other row. The few
hits are shuffled by article to drop a match lying strictly inside a longer one.
"""

from __future__ import annotations

from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.functions import text as X
from narrascope.functions.arrays import prefix_sum
from narrascope.operators.util import cut_lineage, join_on_hot_key, sized_broadcast, small_arrow_batches

NER_MAX_CHARS = 2000
GAZETTEER_METHOD = "gazetteer"
# The entity groups kept as framing targets.
VALUABLE_ENTITY_GROUPS = ("ORG", "GPE", "PER", "PRD", "NOR", "EVT", "LAW", "MON", "REG")

ENTITY_STRUCT = T.StructType([
    T.StructField("entity_group", T.StringType()),
    T.StructField("word", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
ENTITIES_TYPE = T.ArrayType(ENTITY_STRUCT)

_PIECE = f"[^{X.WORD_CLASS}]*[{X.WORD_CLASS}]+"
#: tokens of a chunk
CHUNK_TOKENS = 32
_CHUNK = f"(?:[^{X.WORD_CLASS}]*+[{X.WORD_CLASS}]++){{1,{CHUNK_TOKENS}}}"


def prepare_gazetteer(gazetteer: DataFrame) -> DataFrame:
    """One entry per lowered word: (key, first token, first two tokens, entity_group, score, ntok)."""
    g = gazetteer.select(F.lower("word").alias("key"), "entity_group", F.col("score").cast("double"))
    best = g.groupBy("key").agg(F.max(F.struct("score", "entity_group")).alias("b"))
    toks = F.regexp_extract_all(F.col("key"), F.lit(f"[{X.WORD_CLASS}]+"), 0)
    return best.select("key", F.get(toks, F.lit(0)).alias("first"), F.concat_ws(" ", F.slice(toks, 1, 2)).alias("pair"),
                       F.col("b.entity_group").alias("entity_group"), F.col("b.score").alias("score"), F.size(toks).alias("ntok"))


def _tokens(base: DataFrame) -> DataFrame:
    """A row per token of ``text``: article_id, tok, ``first`` (lowered), ``i`` in its chunk, and of the chunk ``blk``, its start ``off``, its ``pieces``
    (separator and token) and the piece ``after`` it."""
    chunks = base.select("article_id", F.regexp_extract_all("text", F.lit(_CHUNK), F.lit(0)).alias("chunks"))
    ends = prefix_sum(F.transform("chunks", lambda c: F.length(c)))
    parts = F.arrays_zip(F.col("chunks").alias("c"), ends.alias("e"), F.slice("chunks", F.lit(2), F.size("chunks")).alias("n"))
    c = chunks.select("article_id", F.posexplode(parts).alias("blk", "g"))
    c = c.select("article_id", "blk", (F.col("g.e") - F.length("g.c")).alias("off"), F.col("g.c").alias("c"),
                 F.regexp_extract_all("g.c", F.lit(_PIECE), F.lit(0)).alias("pieces"), F.nullif(F.regexp_extract("g.n", f"^{_PIECE}", 0), F.lit("")).alias("after"))
    toks = F.regexp_extract_all("c", F.lit(f"[{X.WORD_CLASS}]+"), F.lit(0))
    return c.select("article_id", "blk", "off", "pieces", "after", F.posexplode(toks).alias("i", "tok")).withColumn("first", F.lower("tok"))


def _next_piece():
    """The piece after a token (null: none)."""
    return F.when(F.col("i") + 1 < F.size("pieces"), F.get("pieces", F.col("i") + 1)).otherwise(F.col("after"))


def _token_end():
    """Where a token ends in its text: the start of its chunk and the lengths of the pieces up to it."""
    upto = F.aggregate(F.slice("pieces", F.lit(1), F.col("i") + 1), F.lit(0), lambda n, p: n + F.length(p))
    return (F.col("off") + upto).cast("int")


def _long_names(base: DataFrame, cand: DataFrame, names: DataFrame) -> DataFrame:
    """The places of names of three tokens or more, by way of their first two: article_id, tok, e, tail (pieces after it), name.

    ``base`` holds an article in one row. The places are written once, so their bytes are known to the join with it.
    """
    pairs = names.groupBy("pair").agg(F.max("ntok").alias("need"))
    begun = cand.withColumn("pair", F.concat_ws(" ", "first", F.lower(F.regexp_extract("nxt", f"[{X.WORD_CLASS}]+", 0))))
    at = join_on_hot_key(begun, pairs, "pair").select("article_id", F.struct("pos", "tok", "e", "pair", "need").alias("at"))
    at = cut_lineage(at.groupBy("article_id").agg(F.collect_list("at").alias("ats")))  # at most the tokens of one article
    held = base.join(sized_broadcast(at), "article_id").select("article_id", "ats", F.regexp_extract_all("text", F.lit(_PIECE), 0).alias("pieces"))
    wide = F.transform("ats", lambda p: p.withField("tail", F.slice("pieces", p["pos"] + 2, p["need"] - 1)))
    rows = held.select("article_id", F.explode(wide).alias("p")).select("article_id", "p.tok", "p.e", "p.tail", "p.pair")
    return join_on_hot_key(rows, names, "pair")


def tag_entities(articles: DataFrame, gazetteer: DataFrame, id_col: str = "id",
                 max_chars: int | None = None, method: str = GAZETTEER_METHOD) -> DataFrame:
    """One row per mention in ``title. summary``.

    ``id_col`` must be unique. The whole text is tagged by default; ``max_chars=NER_MAX_CHARS`` reproduces
    the reference model's input cut when parity with it is wanted.

    Output: article_id, method_name, entity_group, word (surface form),
    score, start_char, end_char (0-based, end exclusive).
    """
    gz = prepare_gazetteer(gazetteer).where(F.col("ntok") >= 1)
    max_n = gz.agg(F.max("ntok")).first()[0] or 0
    if max_n == 0:
        return articles.sparkSession.createDataFrame([], MENTION_SCHEMA)

    text = X.article_text("title", "summary", ". ")
    if max_chars:
        text = F.substring(text, 1, max_chars)
    base = articles.select(F.col(id_col).alias("article_id"), text.alias("text"))
    cand = _tokens(base)
    # the places are read after the join, so only tokens that begin a name are counted off
    word = F.when(F.col("ntok") == 1, F.col("tok")).otherwise(F.concat("tok", F.coalesce(_next_piece(), F.lit(""))))
    found = ["article_id", "tok", "e", "word", "key", "entity_group", "score"]
    hits = join_on_hot_key(cand, gz.where(F.col("ntok") <= 2).drop("pair"), "first").withColumn("word", word)
    hits = hits.where(F.lower("word") == F.col("key")).withColumn("e", _token_end()).select(*found)
    if max_n > 2:
        names = gz.where(F.col("ntok") > 2)
        begin = join_on_hot_key(cand, names.select("first").distinct(), "first", "left_semi")
        begin = begin.select("article_id", (F.col("blk") * CHUNK_TOKENS + F.col("i")).alias("pos"), "tok", _token_end().alias("e"), _next_piece().alias("nxt"), "first")
        long = _long_names(base, begin, names.drop("first"))
        tail = F.array_join(F.slice("tail", F.lit(1), F.col("ntok") - 1), "")
        hits = hits.unionByName(long.withColumn("word", F.concat("tok", tail)).select(*found))
    start = F.col("e") - F.length("tok")
    hits = (hits.where(F.lower("word") == F.col("key"))
            .select("article_id", "entity_group", "word", "score", start.alias("start_char"), (start + F.length("word")).alias("end_char")))
    # drop a match that lies strictly inside a longer one of the same article
    w = (Window.partitionBy("article_id").orderBy(F.asc("start_char"), F.desc("end_char"))
         .rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("_cover", F.max("end_char").over(w))
    return (hits.where(F.col("_cover").isNull() | (F.col("_cover") < F.col("end_char")))
            .select("article_id", F.lit(method).alias("method_name"), "entity_group", "word",
                    "score", "start_char", "end_char"))


MENTION_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("method_name", T.StringType()),
    T.StructField("entity_group", T.StringType()),
    T.StructField("word", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
])


def tag_entities_model(articles: DataFrame, factory: Callable[[], Callable[[list[str]], list]],
                       method: str, id_col: str = "id", max_chars: int | None = None, batch_size: int = 64) -> DataFrame:
    """Any user model, loaded once per partition and applied by batch (``mapInPandas``).

    ``factory()`` returns a model; ``model(texts)`` returns, per text, an iterable of dicts (keys
    entity_group, word, score, start, end, any may be missing). A batch that fails is tried text by text;
    a text that fails gives an empty list, as in the reference, and ``failed`` 1, so failures can be counted.
    The texts reach Python in batches bounded by bytes, and each is tagged once: the result is checkpointed.
    Output: article_id, method, entities, failed.
    """
    text = X.article_text("title", "summary", ". ")
    if max_chars:
        text = F.substring(text, 1, max_chars)
    src = articles.select(F.col(id_col).alias("article_id"), text.alias("text"))
    out_schema = T.StructType([T.StructField("article_id", T.LongType()),
                               T.StructField("method", T.StringType()),
                               T.StructField("entities", ENTITIES_TYPE),
                               T.StructField("failed", T.IntegerType())])

    def plain(entities) -> list[dict]:
        return [{k: e.get(k) for k in ENTITY_STRUCT.names} for e in entities]

    def predict(model, texts: list[str]) -> list[tuple[list, int]]:
        try:
            found = [plain(e) for e in model(texts)]
            if len(found) != len(texts):
                raise ValueError("the model returned another number of results")
            return [(e, 0) for e in found]
        except Exception:  # the model is the user's: any failure is this article's, and counted
            if len(texts) == 1:
                return [([], 1)]
            return [r for t in texts for r in predict(model, [t])]

    def run(batches):
        model = None
        for pdf in batches:
            model = model or factory()
            texts = [t or "" for t in pdf["text"]]
            rows = [r for i in range(0, len(texts), batch_size) for r in predict(model, texts[i:i + batch_size])]
            yield pd.DataFrame({"article_id": pdf["article_id"], "method": method, "entities": [r[0] for r in rows],
                                "failed": [r[1] for r in rows]})

    with small_arrow_batches(src.sparkSession):
        return cut_lineage(src.mapInPandas(run, out_schema))


def explode_entities(df: DataFrame, entities_col: str = "entities", id_col: str = "article_id",
                     method_col: str = "method") -> DataFrame:
    """One row per entity, defaults for missing fields; empty list gives no rows."""
    e = F.col("e")
    return (df.select(F.col(id_col).alias("article_id"), F.col(method_col).alias("method_name"),
                      F.explode(entities_col).alias("e"))
            .select("article_id", "method_name",
                    F.coalesce(e["entity_group"], F.lit("UNKNOWN")).alias("entity_group"),
                    F.coalesce(e["word"], F.lit("")).alias("word"),
                    F.coalesce(e["score"].cast("double"), F.lit(0.0)).alias("score"),
                    F.coalesce(e["start"].cast("int"), F.lit(0)).alias("start_char"),
                    F.coalesce(e["end"].cast("int"), F.lit(0)).alias("end_char")))


def framing_targets(mentions: DataFrame, groups: Iterable[str] = VALUABLE_ENTITY_GROUPS) -> DataFrame:
    """distinct (article_id, entity_word) of the valuable groups, case-sensitive."""
    return (mentions.where(F.col("entity_group").isin(list(groups)))
            .select("article_id", F.col("word").alias("entity_word")).distinct())
