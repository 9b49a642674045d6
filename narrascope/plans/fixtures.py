"""Bindings of the driver's tables to the engine's inputs (FIXTURES.md section 2).

Every view is derived by Spark from the given parquet tables, so its size
grows with them. The same views are written as DuckDB CTEs in
``narrascope.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrascope.functions import text as T
from narrascope.operators.util import cut_lineage

# Fixed values of the bindings.
URL_PREFIX = "https://news.example/"
EPOCH = "2024-01-01 00:00:00"
MINUTES_PER_DOC = 37
VOCAB_TOP = 230          # stopwords are ranks 1-30, lexicon ranks 31-230
STOP_LAST = 30
GAZ_FIRST, GAZ_LAST = 41, 120
NAME_PAIRS = 20          # two-word names: each of the first tokens with the next in rank
GAZ_GROUPS = ["PER", "ORG", "GPE", "NOR", "EVT", "LAW", "LOC", "DAT"]
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``articles``: id, ord, title, summary, url, published_at, source, lang."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", ".", 1)  # all before the first full stop
    url_num = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("ord"),
        title.alias("title"),
        F.expr("substr(text, length(substring_index(text, '.', 1)) + 2)").alias("summary"),
        F.concat(F.lit(URL_PREFIX), url_num.cast("string")).alias("url"),
        F.expr(f"timestampadd(MINUTE, doc_id * {MINUTES_PER_DOC}, timestamp_ntz'{EPOCH}')")
        .alias("published_at"),
        "source", "lang",
    )


def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``html_articles`` from ``pages``: title element text, summary = html, url kept."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("id"),
        F.col("page_id").alias("ord"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("summary"),
        "url",
    )


def vocab(arts: DataFrame) -> DataFrame:
    """Every token of lowered ``title. summary`` with its document frequency."""
    toks = F.array_distinct(F.array_remove(F.split(F.lower(T.article_text("title", "summary", ". ")), TOKEN_SPLIT), ""))
    return (arts.select("id", F.explode(toks).alias("token"))
            .groupBy("token").agg(F.count("*").alias("df")))


def ranked_vocab(v: DataFrame) -> DataFrame:
    """Top ``VOCAB_TOP`` tokens of a vocabulary by ``df desc, token`` with their rank (a top-k, not a global sort)."""
    top = v.orderBy(F.desc("df"), F.asc("token")).limit(VOCAB_TOP)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), F.asc("token"))))


def stopwords(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") <= STOP_LAST).select(F.col("token").alias("word"))


def lexicon(ranked: DataFrame) -> DataFrame:
    """(word, weight) with integer weights ``rank % 11 - 5``."""
    return (ranked.where((F.col("rank") > STOP_LAST) & (F.length("token") >= 3))
            .select(F.col("token").alias("word"),
                    ((F.col("rank") % 11) - 5).cast("double").alias("weight")))


def positive_lexicon(ranked: DataFrame) -> DataFrame:
    return lexicon(ranked).where(F.col("weight") > 0)


def negative_lexicon(ranked: DataFrame) -> DataFrame:
    return lexicon(ranked).where(F.col("weight") < 0)


def stem_map(v: DataFrame) -> DataFrame:
    """(token, stem): tokens of a vocabulary ending in ``s``, four letters or more, lose the ``s``."""
    return (v.where(F.col("token").endswith("s") & (F.length("token") >= 4))
            .select("token", F.expr("substr(token, 1, length(token) - 1)").alias("stem")))


def gazetteer(ranked: DataFrame) -> DataFrame:
    """(word, entity_group, score) from vocab ranks 41-120, length 4 or more, and two-word names of the top ranks."""
    groups = F.array(*[F.lit(g) for g in GAZ_GROUPS])
    single = ranked.where(F.col("rank").between(GAZ_FIRST, GAZ_LAST) & (F.length("token") >= 4)).select("token", "rank")
    after = ranked.select(F.col("token").alias("next"), (F.col("rank") - 1).alias("rank"))
    pairs = (ranked.where(F.col("rank") <= NAME_PAIRS).join(after, "rank")
             .select(F.concat_ws(" ", "token", "next").alias("token"), "rank"))
    return (single.unionByName(pairs)
            .select(F.col("token").alias("word"),
                    F.element_at(groups, (F.col("rank") % len(GAZ_GROUPS) + 1).cast("int")).alias("entity_group"),
                    (F.lit(0.5) + (F.col("rank") % 5) / F.lit(8.0)).alias("score")))


def search_entity(ranked: DataFrame) -> DataFrame:
    """One-row frame with the searched entity: the best-ranked gazetteer word."""
    return (ranked.where(F.col("rank").between(GAZ_FIRST, GAZ_LAST) & (F.length("token") >= 4))
            .orderBy("rank").limit(1).select(F.col("token").alias("entity")))


class Bindings:
    """Lazily built, cached views for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict = {}

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    @property
    def articles(self) -> DataFrame:
        return self._get("articles", lambda: articles(self.spark, self.sf_dir))

    @property
    def vocab(self) -> DataFrame:
        # the ranks and the stems both come from it; counted once (reliable checkpoint)
        return self._get("vocab", lambda: cut_lineage(vocab(self.articles), up=None))

    @property
    def ranked(self) -> DataFrame:
        # Small (VOCAB_TOP rows); cached so each query does not recount the corpus.
        return self._get("ranked", lambda: ranked_vocab(self.vocab).cache())

    @property
    def stopwords(self) -> DataFrame:
        return stopwords(self.ranked)

    @property
    def positive(self) -> DataFrame:
        return positive_lexicon(self.ranked)

    @property
    def negative(self) -> DataFrame:
        return negative_lexicon(self.ranked)

    @property
    def stem_map(self) -> DataFrame:
        # a stemming dictionary: derived once and materialised (reliable checkpoint)
        return self._get("stem_map", lambda: cut_lineage(stem_map(self.vocab), up=None))

    @property
    def gazetteer(self) -> DataFrame:
        return gazetteer(self.ranked)

    @property
    def entity(self) -> str:
        return self._get("entity", lambda: search_entity(self.ranked).first()["entity"])

    @property
    def language_model(self):
        from narrascope.operators.language import train_language_model

        # trained on the whole labelled documents table
        return self._get("lm", lambda: train_language_model(self.table("documents"), "text", "lang"))

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)
