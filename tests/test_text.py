import hashlib
import re

from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.functions.arrays import prefix_sum


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_whitespace_matches_python(spark):
    s = "a  b c\u001cd\t\ne  "
    assert one(spark, X.normalize_whitespace("s"), s) == re.sub(r"\s+", " ", s).strip()
    assert one(spark, X.normalize_whitespace("s"), None) == ""


def test_strip_html_drops_script_style_comments_and_decodes(spark):
    html = "<p>a<script>var x='<b>';</script>b<!-- c --><style>p{}</style> &amp; &#233;&#x41;&nbsp;<br/>z</p>"
    assert one(spark, X.strip_html("s"), html) == "ab & éA z"


def test_content_hash_is_md5_of_lowered_pair(spark):
    df = spark.createDataFrame([("Ab", "Cd")], "t string, s string")
    got = df.select(X.content_hash("t", "s")).first()[0]
    assert got == hashlib.md5("ab|cd".encode()).hexdigest()


def test_tokenize_drops_urls_punctuation_and_splits_contractions(spark):
    got = one(spark, X.tokenize("s"), "Hello, WORLD! see http://x.y/z?q=1 cannot_do gonna o'clock ½ 3")
    assert got == ["hello", "world", "see", "cannot_do", "gon", "na", "oclock", "½", "3"]


def test_split_sentences(spark):
    got = one(spark, X.split_sentences(X.clean_for_sentences("s")), "One two. Three!  Four?\nFive")
    assert got == ["one two.", "three!", "four?", "five"]


def test_prefix_sum_matches_running_total(spark):
    import itertools
    import random

    rnd = random.Random(1)
    rows = [([rnd.randint(0, 9) for _ in range(rnd.randint(0, 300))],) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<int>")
    for (a,), (got,) in zip(rows, df.select(prefix_sum(F.col("a"))).collect()):
        assert got == list(itertools.accumulate(a))


def test_strip_html_pairs(spark):
    """Fixed pairs, spelled out."""
    pairs = [("caf&eacute; &uuml;ber &ntilde; &Omega;", "café über ñ Ω"), ('<a title="x>y">t</a>u', "tu"), ("<b data-x='>'>k</b>", "k"),
             ("a<template><p>no</p></template>b", "ab"), ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢"),
             ("&copy 2020 &notaname; &amp;lt; &", "© 2020 &notaname; &lt; &"), ("&#150;&#x80;&#0;&#1114112;&#99999999999999;", "–€\ufffd\ufffd\ufffd"),
             ("x < y && z > 1", "x < y && z > 1"), ("<p " + "a='1' " * 3000 + ">deep</p>", "deep"), (None, "")]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pairs)], "i int, s string")
    got = {r["i"]: r["r"] for r in rows.select("i", X.strip_html("s").alias("r")).collect()}
    assert [got[i] for i in range(len(pairs))] == [t for _, t in pairs]


def test_prefix_sum_is_a_small_expression():
    """Nested once per step, planning it took seconds."""
    assert len(str(prefix_sum(F.col("a"))._jc)) < 3000


def test_the_text_is_named_once_in_the_plan_of_tokenize(spark):
    """Outside generated code each naming is computed again: six times for the contractions alone."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(F.explode(X.tokenize("s")).alias("t"))
    shown = plan._jdf.queryExecution().analyzed().toString()
    assert shown.count("lower(coalesce(s") == 1
    shown = spark.range(1).select(F.col("id").cast("string").alias("s")).select(X.strip_html("s").alias("t"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("coalesce(s") == 1


def test_sentences_keep_no_whitespace_at_their_ends(spark):
    """Ends of the text, marks of its own and the sentence mark itself, against Python."""
    for text in ("  a b.  c!\t", "\u2003x. \u00a0y \u0001 z ", "a.\n\nb", " ", "", "one", "\u0001 a \u0001\u0001b. ", "a ?! b."):
        want = [x.strip() for x in re.sub(r"([.!?]+)\s+", "\\1\x01", text).split("\x01")]
        assert one(spark, X.split_sentences("s"), text) == [x for x in want if x]
    assert one(spark, X.split_sentences("s"), None) is None
    assert one(spark, X.clean_for_sentences("s"), " \u2003A http://x.y\nB \n") == "a  b"
