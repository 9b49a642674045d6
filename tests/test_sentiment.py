from narrascope.operators.sentiment import analyze_sentiment, sentiment_distribution


def score(spark, text, pos, neg, stop=(), stems=()):
    arts = spark.createDataFrame([(1, text, "")], "id long, title string, summary string")
    p = spark.createDataFrame(pos or [("zz_none", 1.0)], "word string, weight double")
    n = spark.createDataFrame(neg or [("zz_none2", -1.0)], "word string, weight double")
    sw = spark.createDataFrame([(w,) for w in stop] or [("zz_none3",)], "word string")
    sm = spark.createDataFrame(list(stems) or [("zz_x", "zz")], "token string, stem string")
    return analyze_sentiment(arts, sw, sm, p, n).first()


def test_word_in_both_lexicons_adds_both_and_repeats_count(spark):
    r = score(spark, "good good", [("good", 2.0)], [("good", -0.5)])
    assert r["score"] == 3.0 and r["label"] == "positive" and r["polarity"] == 1.0


def test_stopword_removed_before_stemming(spark):
    # "bads" is a stopword whose stem "bad" is in the lexicon: it adds nothing
    r = score(spark, "bads", [], [("bad", -1.0)], stop=["bads"], stems=[("bads", "bad")])
    assert r["score"] == 0.0 and r["label"] == "neutral"
    r = score(spark, "bads", [], [("bad", -1.0)], stems=[("bads", "bad")])
    assert r["score"] == -1.0 and r["label"] == "negative"


def test_empty_text_scores_zero(spark):
    r = score(spark, "", [("good", 1.0)], [])
    assert r["score"] == 0.0 and r["label"] == "neutral"


def test_distribution_has_fixed_labels(spark):
    s = spark.createDataFrame([(1, "positive"), (2, "error")], "article_id long, label string")
    got = {r["label"]: r["count"] for r in sentiment_distribution(s).collect()}
    assert got == {"positive": 1, "negative": 0, "neutral": 0, "error": 1}
