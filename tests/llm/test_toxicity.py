"""Noisy-or toxicity: held-out accuracy, located sentences, odd rows."""

import zlib

import pytest

from narrascope.llm import toxicity as T


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    return {r["doc_id"]: r for r in T.op3_toxicity(docs, labels).collect()}, docs, labels


def test_held_out_accuracy(scored):
    rows, docs, labels = scored
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [i for i in y if rows[i]["held_out"]]
    caught = [i for i in held if rows[i]["predicted"]]
    assert sum(y[i] for i in caught) / len(caught) > 0.9  # clean documents stay
    plain = [i for i in held if y[i] == 0]
    assert sum(rows[i]["predicted"] for i in plain) / len(plain) < 0.01
    toxic = [i for i in held if y[i] == 1]
    assert sum(rows[i]["predicted"] for i in toxic) / len(toxic) > 0.5  # the rest is label noise: no word marks it


def test_noisy_or_locates_the_sentence(spark):
    good = "Das ist gut. Alles ruhig hier. Noch ein Satz."
    rows = [(i, good + (" Du bist ein Schuft und Halunke." if i % 4 == 0 else ""), i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "doc_id long, text string, toxic int")
    model = T.fit(df)
    assert {"schuft", "halunke"} <= set(model.weights)
    found = {r["doc_id"]: r for r in T.offending_sentences(df, model).collect()}
    assert set(found) == {i for i, _, y in rows if y}
    assert all(r["sentence"].strip() == "Du bist ein Schuft und Halunke." for r in found.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "İdiot. ein Text", "x"), (2, "a " * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    out = T.op3_toxicity(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    none = labels.limit(0)
    assert [r["predicted"] for r in T.op3_toxicity(docs, none).collect()] == [0] * 4
    assert T.op3_toxicity(docs.limit(0), labels).count() == 0
    assert T.reject_toxic(docs, none).columns == docs.columns


def test_every_term_that_passes_is_kept(spark):
    word = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    common = " ".join(word(i) for i in range(4200))
    rows = [(i, common if i < 100 else "Du Schuft." if i < 106 else "Alles ruhig hier.", int(i < 106)) for i in range(2000)]
    terms = T.choose_terms(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert len(terms) == 4202 and "schuft" in terms


def test_terms_outside_the_fitted_rows_have_weight(spark):
    ids = spark.range(4000).selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()  # fitted rows are the least hashes
    rows = [(r["id"], "Du Schuft." if k >= 3992 else "Ein Halunke." if k % 10 == 0 else "Alles ruhig hier.", int(k >= 3992 or k % 10 == 0)) for k, r in enumerate(ids)]
    model = T.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), max_rows=400)
    assert all(T.noisy_or(model, T.sentence_scores(model, t, frozenset(model.weights))) > 0.7 for t in ("Du Schuft.", "Ein Halunke."))


def test_jobs_of_the_fit_do_not_follow_the_partitions(spark):
    rows = spark.range(400).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'vile filth', 'kind words'), '. Number ', id, '.') as text", "cast(id % 2 = 0 as int) as toxic")
    sc, jobs, models = spark.sparkContext, [], []
    for parts in (4, 40):
        sc.setJobGroup(f"fit-{parts}", "fit")
        models.append(T.fit(rows.repartition(parts, "doc_id")))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit-{parts}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert models[0].weights and models[0].weights.keys() == models[1].weights.keys()
    assert all(abs(models[0].weights[w] - models[1].weights[w]) < 1e-9 for w in models[0].weights)
    assert 0 < jobs[1] <= jobs[0] + 4
