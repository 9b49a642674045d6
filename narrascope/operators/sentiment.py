"""Lexicon sentiment.

The stopwords, the stem table and both lexicons are folded into one small table, raw token to
weight, before any text is read. Tokens are exploded once and joined to it (broadcast if it is
measured to be small, else with hot tokens spread), so only tokens that count reach the per-article
sum, a partial aggregation. Articles without such a token come back with score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.operators.storage import assert_unique
from narrascope.operators.util import join_on_hot_key

METHOD = "inset"
LABELS = ("positive", "negative", "neutral")


def explode_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(article_id, pos, tok); one null-token row for an article without tokens."""
    return df.select(F.col(id_col).alias("article_id"),
                     F.posexplode_outer(tokens_col).alias("pos", "tok"))


def remove_stopwords(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drop stopword tokens (repeats of other tokens kept), before stemming."""
    return join_on_hot_key(tokens, stopwords.select(F.col("word").alias("tok")).distinct(), "tok", "left_anti")


def stem_tokens(tokens: DataFrame, stem_map: DataFrame | None) -> DataFrame:
    """T4: each token replaced by its stem; no stem table, or no entry, leaves it unchanged.

    A token with more than one stem is an error.
    """
    if stem_map is None:
        return tokens
    assert_unique(stem_map, "token", "the stem table")
    j = join_on_hot_key(tokens, stem_map.select(F.col("token").alias("tok"), F.col("stem").alias("_s")), "tok", "left")
    return j.select(*[c for c in tokens.columns if c != "tok"], F.coalesce("_s", "tok").alias("tok"))


def word_weights(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(word, weight): both lexicons summed. A word twice in one lexicon is an error."""
    assert_unique(positive, "word", "the positive lexicon")
    assert_unique(negative, "word", "the negative lexicon")
    both = positive.select("word", "weight").unionByName(negative.select("word", "weight"))
    return both.groupBy("word").agg(F.sum("weight").alias("weight"))


def token_weights(stopwords: DataFrame, stem_map: DataFrame | None, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """T3-T5 folded: (tok, weight) of every raw token that is no stopword and whose stem has a weight."""
    weights = word_weights(positive, negative).filter(F.col("word").isNotNull())
    if stem_map is None:
        table = weights.select(F.col("word").alias("tok"), "weight")
    else:
        assert_unique(stem_map, "token", "the stem table")
        stemmed = stem_map.select(F.col("token").alias("tok"), F.col("stem").alias("word")).join(weights, "word").select("tok", "weight")
        plain = weights.select(F.col("word").alias("tok"), "weight").join(stem_map.select(F.col("token").alias("tok")), "tok", "left_anti")
        table = stemmed.unionByName(plain)
    return table.join(stopwords.select(F.col("word").alias("tok")).distinct(), "tok", "left_anti")


def lexicon_score(tokens: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """T5: (article_id, raw_score): sum of positive + negative weights with repeats; 0 without any."""
    j = join_on_hot_key(tokens, word_weights(positive, negative).withColumnRenamed("word", "tok"), "tok", "left")
    return j.groupBy("article_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).cast("double").alias("raw_score"))


def label_sentiment(df: DataFrame, score_col: str = "raw_score", method: str = METHOD) -> DataFrame:
    """Polarity, subjectivity, label and method from the raw score."""
    s = F.col(score_col)
    return df.select(
        "*",
        F.lit(method).alias("method_name"),
        F.when(s > 0, 1.0).when(s < 0, -1.0).otherwise(0.0).alias("polarity"),
        F.lit(0.0).alias("subjectivity"),
        F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral").alias("label"),
    )


def score_text(df: DataFrame, text: Column, stopwords: DataFrame, stem_map: DataFrame | None,
               positive: DataFrame, negative: DataFrame, id_col: str = "id") -> DataFrame:
    """T1-T5 on an arbitrary text column: (article_id, raw_score) for every input row."""
    weights = token_weights(stopwords, stem_map, positive, negative)
    toks = df.select(F.col(id_col).alias("article_id"), F.explode(X.tokenize(text)).alias("tok"))
    sums = join_on_hot_key(toks, weights, "tok").groupBy("article_id").agg(F.sum("weight").alias("s"))
    ids = df.select(F.col(id_col).alias("article_id"))
    return ids.join(sums, "article_id", "left").select("article_id", F.coalesce("s", F.lit(0.0)).cast("double").alias("raw_score"))


def analyze_sentiment(articles: DataFrame, stopwords: DataFrame, stem_map: DataFrame | None,
                      positive: DataFrame, negative: DataFrame, id_col: str = "id",
                      text: Column | None = None, method: str = METHOD) -> DataFrame:
    """Sentiment rows (article_id, method_name, polarity, subjectivity, label, score).

    The text defaults to ``title. summary``. Native expressions do not fail per
    row, so the ``error`` label of the reference never arises here.
    """
    text = X.article_text("title", "summary", ". ") if text is None else text
    scored = score_text(articles, text, stopwords, stem_map, positive, negative, id_col)
    return (label_sentiment(scored, method=method)
            .select("article_id", "method_name", "polarity", "subjectivity", "label",
                    F.col("raw_score").alias("score")))


def sentiment_distribution(sentiments: DataFrame) -> DataFrame:
    """(label, count); positive, negative, neutral always present."""
    counts = sentiments.groupBy("label").agg(F.count("*").alias("n"))
    fixed = counts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label"))
    return (fixed.join(counts, "label", "full_outer")
            .select("label", F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def sentiment_stats(sentiments: DataFrame) -> DataFrame:
    """One-row stats: total_analyzed and the label distribution as a map (for W4)."""
    dist = sentiment_distribution(sentiments)
    return dist.agg(
        F.sum("count").cast("long").alias("total_analyzed"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("sentiment_distribution"))
