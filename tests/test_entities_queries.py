import datetime as dt

from narrascope.operators import entities as N
from narrascope.operators import queries as Q


def test_gazetteer_tagging_offsets_and_containment(spark):
    text = "Joko Widodo met Joko in Jakarta, joko-widodo"
    arts = spark.createDataFrame([(1, text, "")], "id long, title string, summary string")
    gaz = spark.createDataFrame([("joko widodo", "PER", 0.9), ("joko", "PER", 0.6), ("jakarta", "GPE", 0.7)],
                                "word string, entity_group string, score double")
    got = sorted((r["word"], r["start_char"], r["end_char"]) for r in N.tag_entities(arts, gaz).collect())
    full = text + ". "
    assert all(full[s:e] == w for w, s, e in got)
    # "Joko" inside "Joko Widodo" is dropped; "joko-widodo" is no match for the two-word name
    assert got == [("Jakarta", 24, 31), ("Joko", 16, 20), ("Joko Widodo", 0, 11), ("joko", 33, 37)]


def test_explode_entities_defaults(spark):
    df = spark.createDataFrame([(1, "m", [{"word": "a"}, {"entity_group": "PER"}]), (2, "m", [])],
                               "article_id long, method string, entities array<struct<entity_group:string,"
                               "word:string,score:double,start:int,end:int>>")
    got = sorted(tuple(r)[2:] for r in N.explode_entities(df).collect())
    assert got == [("PER", "", 0.0, 0, 0), ("UNKNOWN", "a", 0.0, 0, 0)]


def _tables(spark):
    arts = spark.createDataFrame([(1, dt.datetime(2024, 1, 5, 9)), (2, dt.datetime(2024, 1, 6, 10))],
                                 "id long, published_at timestamp_ntz")
    ment = spark.createDataFrame(
        [(1, "a", "PER", 0.9), (1, "a", "PER", 0.9), (1, "b", "ORG", 0.9), (1, "b", "ORG", 0.9),
         (1, "b", "ORG", 0.1), (2, "a", "PER", 0.9)],
        "article_id long, word string, entity_group string, score double")
    return arts, ment


def test_links_count_mention_pairs_and_ignore_score_floor(spark):
    arts, ment = _tables(spark)
    nodes, links = Q.network(arts, ment, "A", "2024-01-01", "2024-02-01", min_score=0.5)
    assert {(r["source"], r["target"], r["value"]) for r in links.collect()} == {("a", "b", 6)}
    assert {r["id"]: (r["group"], r["count"]) for r in nodes.collect()} == {"a": ("SEARCHED", 2), "b": ("ORG", 1)}


def test_bare_end_date_is_midnight(spark):
    arts, _ = _tables(spark)
    assert [r["id"] for r in Q.in_range(arts, "2024-01-01", "2024-01-06").collect()] == [1]
    s, e = Q.date_bounds(None, "2024-01-06")
    assert e == dt.datetime(2024, 1, 6) and e - s == dt.timedelta(days=7)


def test_trends_count_joined_rows_and_pivot(spark):
    arts, ment = _tables(spark)
    sent = spark.createDataFrame([(1, "positive"), (1, "negative"), (2, "neutral")], "article_id long, label string")
    t = Q.trends(arts, ment, sent, "a", "2024-01-01", "2024-02-01")
    assert sorted(tuple(r) for r in t.collect()) == [
        (dt.date(2024, 1, 5), "negative", 2), (dt.date(2024, 1, 5), "positive", 2), (dt.date(2024, 1, 6), "neutral", 1)]
    p = [tuple(r) for r in Q.trend_pivot(t).collect()]
    assert p == [(dt.date(2024, 1, 5), 2, 0, 2), (dt.date(2024, 1, 6), 0, 1, 0)]


def test_user_model_loads_once_and_counts_failures(spark):
    class Model:
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[{"word": t[:3], "start": 0, "end": 3}] for t in texts]

    arts = spark.createDataFrame([(i, "bad one" if i == 3 else f"txt {i}", "") for i in range(8)], "id long, title string, summary string").coalesce(1)
    rows = N.tag_entities_model(arts, Model, "m", batch_size=4).collect()
    assert {r["article_id"]: r["failed"] for r in rows} == {i: int(i == 3) for i in range(8)}
    assert all((len(r["entities"]) == 1) != bool(r["failed"]) for r in rows)


def test_stored_lower_word_is_pushed_down(spark, tmp_path):
    arts, ment = _tables(spark)
    from pyspark.sql import functions as F

    ment.withColumn("word_lower", F.lower("word")).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    q = Q.entity_articles(arts, stored, "A", "2024-01-01", "2024-02-01")
    assert "PushedFilters: [IsNotNull(word_lower), EqualTo(word_lower,a)" in q._jdf.queryExecution().toString()
    assert sorted(r[0] for r in q.collect()) == [1, 2]


def test_registered_model_query_is_native(spark):
    import re

    from narrascope.plans import catalog

    titles = ["Anna Berg met Bob", "xAnna _Anna 5Anna HelloWorld", "Ünder Éa éAnna 𝒳 Karl Otto", "", None, "A Be C", "Zoe", "Ab  Cd\nEf Gh-Ij"]
    df = spark.createDataFrame([(i, t, "Ende. Gut" if i % 2 else None) for i, t in enumerate(titles)], "id long, title string, summary string")
    got = sorted((r["article_id"], r["start_char"], r["end_char"], r["word"]) for r in N.explode_entities(catalog.capitalized_runs(df)).collect())
    want = []
    for i, t in enumerate(titles):
        text = f"{t or ''}. {'Ende. Gut' if i % 2 else ''}"
        want += [(i, m.start(), m.end(), m[0]) for m in re.finditer(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", text, re.ASCII)]
    assert got == sorted(want)
    plan = catalog.REGISTRY["tag_entities_model"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Python" not in plan


def test_names_of_many_tokens_match_a_loop_over_tokens(spark, monkeypatch):
    import random
    import re

    from pyspark.sql import functions as F

    from narrascope.operators import entities

    rnd = random.Random(5)
    sixty = " ".join(f"w{i}" for i in range(60))
    names = ["a", "b a", "a b c", "a b d", "a b c d", "b  c a", "c-a b a", "d.", sixty]
    gaz = [(n, "ORG", 0.5 + i / 100) for i, n in enumerate(names)]
    texts = ["".join(rnd.choice("aAbBcd") + rnd.choice([" ", " ", " ", "  ", "-", ". "]) for _ in range(rnd.randint(0, 80))) for _ in range(30)]
    texts += [f"w0 w1 {sixty.upper()} a b", f"{sixty[:-1]}", "", "a b", sixty]
    want = set()
    for i, t in enumerate(texts):
        full = f"{t}. x"
        toks = [(m.start(), m.end()) for m in re.finditer(r"\w+", full)]
        spans = []
        for p, (at, _) in enumerate(toks):
            for n, _, score in gaz:
                k = len(re.findall(r"\w+", n))
                if p + k <= len(toks) and full[at:toks[p + k - 1][1]].lower() == n:
                    spans.append((at, toks[p + k - 1][1], score))
        want |= {(i, full[a:b], a, b, s) for a, b, s in spans if not any(x <= a and b <= y and (x, y) != (a, b) for x, y, _ in spans)}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, title string, summary string")
    table = spark.createDataFrame(gaz, "word string, entity_group string, score double")
    for _ in range(2):
        rows = entities.tag_entities(df, table).collect()
        got = {(r["article_id"], r["word"], r["start_char"], r["end_char"], r["score"]) for r in rows}
        assert len(rows) == len(got) and got == want and any(b - a > 200 for _, _, a, b, _ in got)
        monkeypatch.setattr("narrascope.operators.util.BROADCAST_MAX_BYTES", 0)
    # only the places of a pair that begins a long name are widened
    base = df.select(F.col("id").alias("article_id"), F.concat("title", F.lit(". x")).alias("text"))
    gz = entities.prepare_gazetteer(table)
    cand = spark.createDataFrame([(0, 0, "a", 1, " b", "a"), (30, 0, "w0", 2, " w1", "w0")],
                                 "article_id long, pos int, tok string, e int, nxt string, first string")
    wide = entities._long_names(base, cand, gz.where("ntok > 2").drop("first")).groupBy("article_id").agg(F.max(F.size("tail")).alias("n"))
    assert {r["article_id"]: r["n"] <= 3 for r in wide.collect()}.get(0, True) and [r["n"] for r in wide.where("article_id = 30").collect()] == [59]


def test_places_over_several_chunks(spark, monkeypatch):
    """Names of one to three tokens, in and across chunks of a text: the places of a plain scan."""
    import random
    import re

    rnd = random.Random(6)
    names = ["ab", "cd ef", "ef ab cd"]
    texts = ["".join(rnd.choice(["ab", "Cd", "ef", "é1", "😀x"]) + rnd.choice([" ", ", ", " 😀 ", "\n"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 90)]
    arts = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id long, title string, summary string")
    gaz = spark.createDataFrame([(w, "PER", 0.5) for w in names], "word string, entity_group string, score double")
    monkeypatch.setattr(N, "CHUNK_TOKENS", 3)
    monkeypatch.setattr(N, "_CHUNK", N._CHUNK.replace("{1,32}", "{1,3}"))
    got = {(r["article_id"], r["start_char"], r["end_char"], r["word"]) for r in N.tag_entities(arts, gaz).collect()}
    want = set()
    for i, t in enumerate(texts):
        t = ". " + t
        found = [(m.start(), m.start() + len(w)) for w in names for m in re.finditer(rf"(?<!\w)(?={w}(?!\w))", t.lower())]
        want |= {(i, a, b, t[a:b]) for a, b in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found)}
    assert got == want
