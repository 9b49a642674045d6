"""Line deduplication over levelled runs against a sequential version."""

import hashlib
import random

from narrascope.llm import line_runs as L


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def slow(rows):
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                o = 1 << 63 if i is None else i
                owner[k] = min(o, owner.get(k, o))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (1 << 63 if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_equals_sequential_version(spark):
    rng = random.Random(8)
    pool = [f"Common line number {i}" for i in range(30)] + ["short", "", "ÄÖÜ ÄÖÜ ÄÖ", "ÄÖÜ ÄÖÜ Ä", "\u00a0nbsp line here\u00a0", "  Common LINE number 1\t"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8)) + [f"own line of document {i}"] * rng.randint(0, 2))) for i in range(120)]
    rows += [(500, None), (501, ""), (3, rows[3][1]), (4, "Common line number 5\nsomething else again"), (None, pool[0]), (None, "only without id")]
    rows += [(600, "hot passage line\n" * 20_000)] + [(601 + i, "hot passage line\nrest") for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, h1 int, key string")
    want = slow(rows)
    for batches in (1, 7):  # seven batches fill levels 0 and 1
        got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.op10_line_dedup(df, batches).collect())
        assert got == want
    out = L.drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)


def test_runs_compact_by_level(spark):
    store = L.LineRuns(spark, buckets=2, fanout=2)
    for n in range(4):
        keys = spark.createDataFrame([(h, 0, n, n) for h in range(n, n + 3)], "h1 long, h2 long, low long, high long")
        shared = {(r["h1"], r["owner"]) for r in store.add(keys).collect()}
        assert shared == {(h, max(0, h - 2)) for h in range(n, n + 2) if n}
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert sorted((r["h1"], r["owner"]) for r in store.runs()[0].collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.op10_line_dedup(none).count() == 0
