import random

from pyspark.sql import functions as F

from narrascope.operators import framing as FR


def phrases(spark, text, entity, stop=(), size=7):
    arts = spark.createDataFrame([(1, text, "")], "id long, title string, summary string")
    targets = spark.createDataFrame([(1, entity)], "article_id long, entity_word string")
    sw = spark.createDataFrame([(w,) for w in stop] or [("zz_none",)], "word string")
    return sorted(r["framing_phrase"] for r in FR.frame_entities(arts, targets, sw, size).collect())


def test_substring_gate_and_token_run_both_apply(spark):
    assert phrases(spark, "the u.s army moved north fast", "u.s") == ["army moved north fast"]
    # entity "us" has tokens [us] and the text has token "us" only as "u.s" -> "us" is no substring
    assert phrases(spark, "the u.s army moved north fast", "us") == []


def test_segment_cut_at_any_entity_token(spark):
    # two-token entity "joko widodo"; "widodo" alone inside the window also cuts
    got = phrases(spark, "alpha beta joko widodo gamma delta widodo epsilon zeta", "joko widodo")
    assert got == ["alpha beta", "epsilon zeta", "gamma delta"]


def test_long_segment_gives_first_six_and_last_six(spark):
    text = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 x"
    got = phrases(spark, text, "x", size=12)
    assert got == ["a1 a2 a3 a4 a5 a6", "a5 a6 a7 a8 a9 a10"]


def test_stopwords_trimmed_at_both_ends_only(spark):
    got = phrases(spark, "the big of house x", "x", stop=["the", "of"])
    assert got == ["big of house"]


def test_maximal_drops_character_substrings(spark):
    df = spark.createDataFrame([(["tall green door", "tall green", "all green", "far off"],)], "p array<string>")
    assert sorted(df.select(FR.maximal_phrases(F.col("p"))).first()[0]) == ["far off", "tall green door"]


def brute_maximal(ps):
    d = set(ps)
    return sorted(p for p in d if not any(q != p and p in q for q in d))


def test_corpus_maximal_matches_brute_force(spark):
    rnd = random.Random(3)
    words = ["ab", "abc", "b", "ca", "bca", "c", "aab"]
    ps = {" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 4))) for _ in range(400)}
    df = spark.createDataFrame([(p,) for p in ps], "phrase string")
    for key_len, group_rows in ((3, None), (6, 5), (40, None)):
        got = sorted(r[0] for r in FR.corpus_maximal(df, key_len=key_len, group_rows=group_rows).collect())
        assert got == brute_maximal(ps)


def test_corpus_maximal_of_long_phrases(spark, monkeypatch):
    rnd = random.Random(8)
    ps = {"".join(rnd.choices("ab", k=rnd.randint(0, 40))) for _ in range(150)} | {"ab" * n for n in (1, 9, 30, 31, 200)} | {"héé😀" * 12, "é😀h", "x" * 70}
    ps |= {p[a:a + rnd.randint(5, 60)] for p in list(ps) for a in (0, 3)}
    df = spark.createDataFrame([(p,) for p in ps], "phrase string")
    monkeypatch.setattr(FR, "PIECE", 7)
    for key_len, group_rows in ((3, None), (2, 9)):
        assert sorted(r[0] for r in FR.corpus_maximal(df, key_len=key_len, group_rows=group_rows, cap=6).collect()) == brute_maximal(ps)


def test_a_token_of_a_million_characters(spark):
    rnd = random.Random(9)
    token = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    ps = [f"big {token}", token[5:900_000], "red", token[700_000:700_060], "big", "blue red"]
    got = {r[0] for r in FR.corpus_maximal(spark.createDataFrame([(p,) for p in ps], "phrase string")).collect()}
    assert got == {ps[0], "blue red"}
    n = FR._entries(spark.createDataFrame([(0, token)], "pid long, p string"), [], FR.CAP).agg({"s": "count"}).first()[0]
    assert n == 1_000_000


def test_corpus_maximal_with_half_of_all_phrases_under_one_prefix(spark):
    rnd = random.Random(4)
    ps = {"the same long beginning of " + " ".join(rnd.choices(["ab", "ba", "aab", "b"], k=rnd.randint(1, 5))) for _ in range(400)}
    ps |= {"".join(rnd.choices("abcd ", k=rnd.randint(2, 12))).strip() or "x" for _ in range(200)}
    groups = [(g, p) for g in (1, None) for p in ps if g or rnd.random() < 0.5]
    df = spark.createDataFrame(groups, "g int, phrase string")
    got = {}
    for r in FR.corpus_maximal(df, keys=["g"], group_rows=20).collect():
        got.setdefault(r["g"], []).append(r["phrase"])
    assert {g: sorted(x) for g, x in got.items()} == {g: brute_maximal([p for h, p in groups if h == g]) for g in (1, None)}


def test_one_long_article_that_repeats_its_entity(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(" ".join(rnd.choices(words, k=9)) + " x ." for _ in range(90_000))  # about 5 MB
    arts = spark.createDataFrame([(1, text, "")], "id long, title string, summary string")
    targets = spark.createDataFrame([(1, "x")], "article_id long, entity_word string")
    assert FR.frame_entities(arts, targets, spark.createDataFrame([("w1",)], "word string")).count() > 80_000


def test_long_stopword_lists_are_joined(spark, monkeypatch):
    args = ("the big of house x", "x", ["the", "of"])
    plain = phrases(spark, *args)
    monkeypatch.setattr(FR, "LITERAL_WORDS", 1)
    assert phrases(spark, *args) == plain


def test_corpus_maximality_before_count_rule(spark):
    """A phrase in 3 articles is lost to a longer one found in 1: neither is returned."""
    rows = [(1, "u1", "big red car x", ""), (2, "u2", "red car x", ""), (3, "u3", "red car x", ""),
            (4, "u4", "red car x", "")]
    arts = spark.createDataFrame(rows, "id long, url string, title string, summary string")
    sw = spark.createDataFrame([("zz",)], "word string")
    assert FR.corpus_phrases(arts, "x", sw).count() == 0


def test_an_occurrence_holds_only_the_tokens_around_it(spark):
    """A long sentence with many runs is not copied for each of them."""
    text = " ".join(f"w{i} x" for i in range(500))
    arts = spark.createDataFrame([(1, text, "")], "id long, title string, summary string")
    targets = spark.createDataFrame([(1, "x")], "article_id long, entity_word string")
    occ = FR.occurrences(arts, targets, spark.createDataFrame([("w1",)], "word string"), size=3)
    rows = occ.select("start", "at", "near", "stops").orderBy("start").collect()
    toks = (text + ". ").replace(".", "").split()
    assert [r["start"] for r in rows] == list(range(2, 1001, 2))
    for r in rows:
        lo = max(1, r["start"] - 3)
        assert r["near"][:7] == toks[lo - 1:r["start"] + 3] and r["near"][r["at"] - 1] == "x"
        assert r["stops"] == (["w1"] if "w1" in r["near"] else [])


def test_the_integrity_check_tags_once(spark, monkeypatch, tmp_path):
    import datetime as dt

    from narrascope.plans import catalog as CT

    calls, tag = [], CT.N.tag_entities
    monkeypatch.setattr(CT.N, "tag_entities", lambda *a, **k: calls.append(1) or tag(*a, **k))
    text = "The minister said that the plan is good. The city agrees with the minister. "
    docs = spark.createDataFrame([(i, text * 3 + str(i), "en" if i % 2 else "fr", "src1", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ev = [(i, dt.datetime(2024, 1, 1, i), 1, "signup" if i == 0 else "view", 1.0, '{"k": 1}') for i in range(4)]
    spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["rule"]: r["violations"] for r in CT.q_check_integrity(spark, str(tmp_path)).collect()}
    assert len(got) == 44 and got["articles.url not null"] == 0 and len(calls) == 1


def test_texts_meet_their_targets_in_several_partitions_a_core(spark):
    from narrascope.operators.util import SPREAD_TASKS

    arts = spark.range(200).select("id", F.lit("the door. ").alias("title"), F.col("id").cast("string").alias("summary"))
    targets = arts.select(F.col("id").alias("article_id"), F.lit("door").alias("entity_word"))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "200"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        met = FR._with_targets(arts, targets, "id")
        assert met.rdd.getNumPartitions() == SPREAD_TASKS * spark.sparkContext.defaultParallelism
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4  # two, shown in both plans
        assert met.count() == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
