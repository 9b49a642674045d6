import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from narrascope.operators.language import train_language_model
from narrascope.plans.pipeline import Resources, current, run_pipeline


@pytest.fixture(scope="module")
def res(spark):
    train = spark.createDataFrame(
        [("en", "the minister said the new plan for the city is good and the people agree"),
         ("fr", "le ministre a dit que le nouveau plan pour la ville est bon et les gens sont d'accord")],
        "lang string, text string")
    return Resources(
        stopwords=spark.createDataFrame([("the",), ("is",)], "word string"),
        stem_map=spark.createDataFrame([("plans", "plan")], "token string, stem string"),
        positive=spark.createDataFrame([("good", 1.0)], "word string, weight double"),
        negative=spark.createDataFrame([("bad", -1.0)], "word string, weight double"),
        gazetteer=spark.createDataFrame([("minister", "PER", 0.9), ("city", "GPE", 0.8)],
                                        "word string, entity_group string, score double"),
        language_model=train_language_model(train), target_lang="en")


ROWS = [(0, "The minister speaks", "The minister said the new plan for the city is good.", "http://a/0", "s"),
        (1, "Le ministre parle", "Le ministre a dit que le plan pour la ville est bon.", "http://a/1", "s"),
        (2, "The minister speaks", "The minister said the new plan for the city is good.", "http://a/2", "s"),
        (3, "City news today", "The city said the minister plan is bad for the people.", "http://a/3", "s")]


def articles(spark):
    df = spark.createDataFrame(ROWS, "ord long, title string, summary string, url string, source string")
    return df.withColumn("id", F.col("ord")).withColumn("published_at", F.lit(dt.datetime(2024, 1, 1)))


def snapshot(spark, root):
    return {t: sorted(map(tuple, current(spark, root, t).drop("run_id", "run_date").collect()))
            for t in ("articles", "sentiment_analysis", "named_entity_recognition", "entity_framing")}


def status(spark, root):
    return {r["run_id"]: r["status"] for r in current(spark, root, "pipeline_runs").collect()}


def test_rerun_gives_same_tables(spark, res, tmp_path):
    root = str(tmp_path / "tables")
    out = run_pipeline(spark, articles(spark), root, res, run_id="run-9", run_date=dt.date(2024, 1, 1))
    assert out["total_cleaned"] == 2  # row 2 is a copy of row 0, row 1 is French
    first = snapshot(spark, root)
    for run_id in ("run-9", "run-10", "2024-01-02_00-00-00"):  # the same id again, then ids that sort before it as text
        run_pipeline(spark, articles(spark), root, res, run_id=run_id, run_date=dt.date(2024, 1, 2))
        assert snapshot(spark, root) == first
    assert status(spark, root) == dict.fromkeys(("run-9", "run-10", "2024-01-02_00-00-00"), "completed")
    stats = current(spark, root, "run_statistics").filter("run_id = 'run-9'")
    assert {r["stage"] for r in stats.collect()} == {"collect", "parse", "clean", "signal"}
    assert stats.filter("metric_name = 'total_sources'").first()["metric_value"] == 1.0


def test_runs_add_up_and_ids_stay(spark, res, tmp_path):
    root = str(tmp_path / "tables")
    for n in (9, 10, 11):
        rows = articles(spark).where(F.col("ord").isin(0, 3)).withColumn("url", F.concat(F.lit(f"http://{n}/"), F.col("ord").cast("string")))
        rows = rows.withColumn("title", F.concat("title", F.lit(f" {n}")))
        run_pipeline(spark, rows.drop("id").withColumnRenamed("published_at", "published"), root, res, run_id=f"run-{n}", run_date=dt.date(2024, 1, n))
    got = current(spark, root, "articles").collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5, 6] and {r["run_id"] for r in got} == {"run-9", "run-10", "run-11"}
    assert current(spark, root, "sentiment_analysis").select("article_id").distinct().count() == 6


@pytest.mark.parametrize("stage", ["C.clean_pipeline", "W.upsert_rows", "S.analyze_sentiment", "N.tag_entities", "FR.frame_entities"])
def test_a_failed_run_changes_the_ledger_only(spark, res, tmp_path, monkeypatch, stage):
    from narrascope.plans import pipeline as PL

    root = str(tmp_path / "tables")
    store = PL.TableStore(spark, root)
    # one finished run, written directly: what a failure must leave alone
    at = store.begin("r1")
    at.put("articles", spark.createDataFrame([(7, "t", "http://a/0", "s", "x", dt.datetime(2024, 1, 1), "r1", dt.date(2024, 1, 1))], PL.ARTICLES_SCHEMA))
    at.max_id = 7
    at.publish()
    before = sorted(map(str, current(spark, root, "articles").collect()))

    def fail(*_, **__):
        raise RuntimeError(f"{stage} broke")
    module, name = stage.split(".")
    monkeypatch.setattr(getattr(PL, module), name, fail)
    with pytest.raises(RuntimeError, match="broke"):
        run_pipeline(spark, articles(spark), root, res, run_id="r2", run_date=dt.date(2024, 1, 2))
    assert sorted(map(str, current(spark, root, "articles").collect())) == before
    row = current(spark, root, "pipeline_runs").filter("run_id = 'r2'").first()
    assert row["status"] == "failed" and "broke" in row["errors"]
    if stage == "FR.frame_entities":  # a retry goes through and keeps the old id
        monkeypatch.undo()
        run_pipeline(spark, articles(spark), root, res, run_id="r2", run_date=dt.date(2024, 1, 2))
        assert status(spark, root)["r2"] == "completed"
        assert {r["url"]: r["id"] for r in current(spark, root, "articles").collect()} == {"http://a/0": 7, "http://a/3": 8}


def test_bad_rows_are_counted_or_refused(spark, res, tmp_path):
    root = str(tmp_path / "tables")
    none = articles(spark).withColumn("url", F.when(F.col("ord") > 0, F.col("url")))
    run_pipeline(spark, none, root, res, run_id="r1", run_date=dt.date(2024, 1, 1))
    stats = current(spark, root, "run_statistics").filter("metric_name = 'rejected_no_url'").collect()
    assert [r["metric_value"] for r in stats] == [1.0]
    with pytest.raises(ValueError, match="no order"):
        run_pipeline(spark, none.withColumn("ord", F.when(F.col("ord") > 0, F.col("ord"))), root, res, run_id="r2")


def test_deltas_compact_and_latest_wins(spark, tmp_path, monkeypatch):
    from narrascope.plans import tables as TB

    monkeypatch.setattr(TB, "MAX_DELTAS", 2)
    store = TB.TableStore(spark, str(tmp_path / "t"))
    schema = "article_id long, label string"
    assert store.view("sentiment_analysis") is None
    for n in range(5):
        at = store.begin(f"r{n}")
        keys = spark.createDataFrame([(n,), (n + 1,)], "article_id long")
        at.put("sentiment_analysis", spark.createDataFrame([(n, f"r{n}")], schema), keys)
        at.publish()
        got = {(r["article_id"], r["label"]) for r in store.view("sentiment_analysis").collect()}
        assert got == {(i, f"r{i}") for i in range(n + 1)}
    assert len(store.state().tables["sentiment_analysis"]) <= 2


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_of_two_overlapping_attempts_the_second_to_publish_raises(spark, tmp_path, order):
    from narrascope.plans import tables as TB

    store = TB.TableStore(spark, str(tmp_path / "t"))
    schema = "article_id long, label string"
    for n, base in enumerate((None, "first")):  # from no state, and from one
        both = [store.begin("a"), store.begin("b")]
        for at, name in zip(both, ("0" * 32, "f" * 32)):
            at.id = f"{n}{name[1:]}"
            at.put("sentiment_analysis", spark.createDataFrame([(n, at.run_id)], schema))
        first, second = (both[i] for i in order)
        first.publish()
        with pytest.raises(TB.ConcurrentRunError):
            second.publish()
        assert store.view("sentiment_analysis").filter(F.col("article_id") == n).first()["label"] == first.run_id
    assert store.view("sentiment_analysis").count() == 2
    (tmp_path / "t" / "manifest" / "000000000003.json").write_text('{"seq": 3, "att')  # a writer that died
    retry = store.begin("c")
    retry.put("sentiment_analysis", spark.createDataFrame([(0, "c")], schema))
    retry.publish()
    assert {(r["article_id"], r["label"]) for r in store.view("sentiment_analysis").collect()} == {(0, "c"), (1, first.run_id)}


def test_the_history_is_not_shuffled_by_an_upsert(spark, tmp_path):
    from narrascope.operators import storage as W

    cols = "id long, title string, url string, source string, summary string, published_at timestamp_ntz, run_id string, run_date date"
    old = [(i, "t", f"http://a/{i}", "s", "x", None, "r1", dt.date(2024, 1, 1)) for i in range(500)]
    spark.createDataFrame(old, cols).write.parquet(str(tmp_path / "old"))
    existing = spark.read.parquet(str(tmp_path / "old"))
    incoming = spark.createDataFrame([("http://a/7", 0), ("http://a/new", 1)], "url string, ord long")
    met = W.met_by_url(existing, incoming)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["id"] for r in met.collect()] == [7]


def test_a_search_for_one_word_reads_only_files_that_have_it(spark, tmp_path):
    from narrascope.plans import tables as TB

    store = TB.TableStore(spark, str(tmp_path / "t"))
    at = store.begin("r1")
    rows = spark.range(4000).select(F.col("id").alias("article_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("word_lower"))
    at.put("named_entity_recognition", rows.repartition(4, F.col("article_id") % 7).sortWithinPartitions("word_lower"))
    at.publish()
    found = store.view("named_entity_recognition").filter("word_lower = 'word1234'")
    assert [r["article_id"] for r in found.collect()] == [1234]
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    files = [spark.read.parquet(str(f)) for f in (tmp_path / "t").rglob("rows/part-*.parquet")]
    sizes = [f.count() for f in files if f.filter("word_lower = 'word1234'").count()]
    assert len(files) > 1 and len(sizes) == 1
    assert leaf.metrics().apply("numOutputRows").value() <= sizes[0]


def test_batches_are_named_by_their_files(spark):
    from narrascope.streaming.ingest import batch_id

    of = lambda *paths: batch_id(spark.createDataFrame([(p,) for p in paths], "_path string"))
    assert of("a", "b") == of("b", "a", "a") != of("a") != of("b")
    assert len(of("a")) <= 50


def test_ingest_twice_adds_nothing(spark, res, tmp_path):
    from narrascope.sources.files import write_jsonl
    from narrascope.streaming.ingest import incremental_ingest

    land = tmp_path / "landing"
    write_jsonl(articles(spark).select("title", "url", "summary", F.col("published_at").alias("published"), "source").coalesce(1), str(land / "a"))
    (land / "a" / "bad.json").write_text("{not json\n")
    root, ck = str(tmp_path / "tables"), str(tmp_path / "ck")
    incremental_ingest(spark, str(land / "*"), root, ck, res)
    first = snapshot(spark, root)
    incremental_ingest(spark, str(land / "*"), root, ck, res)
    assert snapshot(spark, root) == first
    assert len(first["articles"]) == 2  # S4's own files, which carry no order
    stats = current(spark, root, "run_statistics").filter("metric_name = 'rejected_lines'").collect()
    assert [r["metric_value"] for r in stats] == [1.0]
    incremental_ingest(spark, str(land / "*"), root, str(tmp_path / "ck2"), res)  # the whole stream replayed
    assert snapshot(spark, root) == first


def test_feeds_go_into_a_run(spark, res, tmp_path):
    """S1 and S2 feed I2 without a hand between them."""
    from narrascope.sources import feeds as SF

    items = "".join(f"<item><title>{t}</title><link>{u}</link><description>{x}</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"
                    for _, t, x, u, _ in ROWS)
    for name, body in (("one", f"<rss version='2.0'><channel><title>c</title>{items}</channel></rss>"), ("two", "<rss><channel>")):
        (tmp_path / f"in/feed={name}").mkdir(parents=True)
        (tmp_path / f"in/feed={name}" / "f.xml").write_text(body, encoding="utf-8")
    listed = spark.createDataFrame([("one", 0), ("two", 1), ("gone", 2)], "feed string, position long")
    path, root = str(tmp_path / "in"), str(tmp_path / "tables")
    stats = SF.feed_stats(spark, path, listed).first().asDict()
    run_pipeline(spark, SF.read_feeds(spark, path, listed), root, res, run_id="r1", collect_stats=stats)
    assert current(spark, root, "articles").count() == 2
    got = {r["metric_name"]: r["metric_value"] for r in current(spark, root, "run_statistics").filter("stage = 'collect'").collect()}
    assert got == {"total_sources": 3.0, "successful": 2.0, "failed": 1.0, "total_articles": 4.0}
    assert current(spark, root, "pipeline_runs").first()["total_sources"] == 3


def kept_files(spark):
    from pathlib import Path

    from narrascope.session import checkpoint_dir
    return {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).glob("rdd-*")}


def test_a_run_leaves_no_intermediate_tables(spark, res, tmp_path):
    res.language_model.wide()  # kept: later runs read it
    before = kept_files(spark)
    out = run_pipeline(spark, articles(spark), str(tmp_path / "t"), res, run_id="r1", run_date=dt.date(2024, 1, 1))
    assert kept_files(spark) <= before
    assert out["articles"].count() == 2 and out["written"]["entity_framing"].count() > 0
    assert current(spark, str(tmp_path / "t"), "run_statistics").filter("metric_name = 'after_dedup'").first()["metric_value"] == 3


def test_a_failed_run_leaves_no_intermediate_tables(spark, res, tmp_path, monkeypatch):
    from narrascope.plans import pipeline as PL

    res.language_model.wide()
    before = kept_files(spark)
    monkeypatch.setattr(PL.N, "tag_entities", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_pipeline(spark, articles(spark), str(tmp_path / "t"), res, run_id="r1", run_date=dt.date(2024, 1, 1))
    assert kept_files(spark) <= before


def test_an_ingest_leaves_no_intermediate_tables(spark, res, tmp_path):
    from narrascope.sources.files import write_jsonl
    from narrascope.streaming.ingest import incremental_ingest

    res.language_model.wide()
    write_jsonl(articles(spark).select("title", "url", "summary", F.col("published_at").alias("published"), "source"), str(tmp_path / "in" / "a"))
    before = kept_files(spark)
    incremental_ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "t"), str(tmp_path / "ck"), res)
    assert kept_files(spark) <= before and current(spark, str(tmp_path / "t"), "articles").count() == 2


def test_a_scratch_inside_another_may_pass_a_table_on(spark):
    from narrascope.operators.util import cut_lineage, scratch

    before = kept_files(spark)
    with scratch(spark):
        with scratch(spark):
            a, b = cut_lineage(spark.range(3)), cut_lineage(spark.range(4), up=1)
            assert a.count() == 3 and len(kept_files(spark) - before) == 2
            c = cut_lineage(spark.range(5), up=None)
        assert b.count() == 4 and len(kept_files(spark) - before) == 2
    assert len(kept_files(spark) - before) == 1 and c.count() == 5
