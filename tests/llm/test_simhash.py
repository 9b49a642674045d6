"""SimHash classes against an independent fingerprint and union-find over all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from narrascope.llm import simhash as S


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(fps):
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_whole_operator(spark):
    rng = random.Random(1)
    words = [f"wort{i}" for i in range(300)] + ["Ünder", "x y", "É"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 400]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + [t + " end" for t in texts[:20]] + [None, "", "  \n\t", "a  b\x0bc", "A b c"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[4], "x"), (None, "only here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    comp = slow_classes({signed(f) for f in fps})
    low = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            low[comp[signed(f)]] = min(i, low.get(comp[signed(f)], 1 << 62))
    want = sorted((str(i), f"{f:016x}", str(low.get(comp[signed(f)]))) for (i, _, _), f in zip(rows, fps))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in S.op5_simhash(df).collect())
    assert got == want
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(low.values()) and ids.count(None) == 1


def test_large_families_link_without_pairs(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for centre in list(fps)[:3]:
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    fps = {signed(f) for f in fps}
    want = slow_classes(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bound in (4, 10_000):
        edges = S.links(df, max_posting=bound)
        got = {f: f for f in fps} | {r["node"]: r["comp"] for r in S.components(edges).collect()}
        assert got == want
        assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).isEmpty()


def test_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {r["comp"] for r in S.components(chain).collect()} == {0}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.op5_simhash(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def test_very_long_text():
    text = "ab cd ef gh " * 200_000
    assert S.fingerprint(text) == S.fingerprint("ab cd ef gh " * 20_000)


def test_one_id_on_several_texts(spark):
    a, near, b, c = "alpha beta gamma", "ALPHA beta  gamma", "one two three", "rot blau gelb"
    for rows, want in (([(5, a), (7, near), (7, b)], [{(5, a)}, {(7, b)}]), ([(7, a), (7, b)], [{(7, a)}, {(7, b)}]),
                       ([(7, a), (7, near), (7, b), (8, b), (9, c), (9, c), (None, c)], [{(7, a), (7, near)}, {(7, b)}, {(9, c)}])):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r["doc_id"], r["text"]) for r in S.drop_near_duplicates(df).collect()]
        assert len(got) == len(want) and all(len(w & set(got)) == 1 for w in want), got
