"""One-bit codes search against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from narrascope.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cid string"


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        near = [(-(ok[q] @ v) / (np.linalg.norm(ok[q]) * np.linalg.norm(v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_matches_brute_force_with_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(400)]
    hot = rows[0][1]
    rows += [(i, hot) for i in range(400, 600)]  # a vector with a third of all rows, queries among them
    rows += [(650, None), (700, [0.0] * 64), (750, [float("nan")] * 64), (800, [None] * 64), (None, hot), (850, []), (900, [1.0, 2.0]), (901, [2.0, 1.0])]
    rows += [(100, rows[100][1])]  # a repeated row
    got, want = run(spark, rows, block_rows=150), brute(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert len(got[q]) == len(near)
        for (a, s), (b, t) in zip(got[q], near):
            assert a == b and abs(s - t) < 1e-9


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows), {}
    for r in ann.op2_rabit(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(len(n) for n in want.values())


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((2000, 96))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    code, scale = ann.encode(v)
    inside = []
    for q in v[:20]:
        est, err = ann.estimate(q @ ann.rotation(96), code, scale)
        inside.append(np.abs(est - v @ q) <= err)
    assert np.mean(inside) > 0.99


def test_empty_and_single(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
