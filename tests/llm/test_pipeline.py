"""The pipeline's stages, each on its own input."""

import corpus_pipeline as C
from narrascope.llm import decontam, simhash, toxicity

D = "/root/testdata/sf0.01"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").cache()
    first = docs.columns
    labels, bench = spark.read.parquet(f"{D}/labels.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in C.STAGES:
        out = stage(spark, docs, D).cache()
        assert out.columns == (first if name != "sharding" else [*first, "shard"])
        before, after = ids(docs), ids(out)
        assert after <= before and out.count() == len(after)
        if name == "toxicity":
            assert before - after == {r["doc_id"] for r in toxicity.op3_toxicity(docs, labels).filter("predicted = 1").collect()} != set()
        elif name == "near_dedup":
            assert after == {r["component_id"] for r in simhash.op5_simhash(docs).collect()}
        elif name == "decontamination":
            assert before - after == {r["doc_id"] for r in decontam.op9_decontaminate(docs, bench).filter("contaminated").collect()} != set()
        elif name == "sharding":
            assert after == before
        docs = out
    whole = C.run(spark, D)
    assert sorted(whole.collect()) == sorted(docs.collect())


def test_odd_rows_go_through(spark):
    rows = [(1, None, None, None, 0, "x"), (None, None, "en", "src0", 0, "x"), (2, "", "en", "src0", 0, "y"), (2, "", "en", "src0", 0, "y"), (3, "some words here", "en", "src1", 15, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for d in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            d = stage(spark, d, D)
            assert set(docs.columns) <= set(d.columns)
            d.count()
