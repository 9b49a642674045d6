"""Decontamination against a word-by-word version."""

import hashlib
import random
import re

from narrascope.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_a_word_has_one_hash_wherever_it_stands():
    for n in (D.SLICE - 1, D.SLICE, D.SLICE + 1):
        word = b"w" * n
        alone = D.words_of(word)
        assert [x.tolist() for x in alone[:2]] == [[0], [n]]
        for data, i in ((word + b" tail", 0), (b"pre " + word, 1), (b"pre " + word + b" tail", 1), (b"a" * (D.SLICE - 2) + b" " + word, 1)):
            s, e, h = D.words_of(data)
            assert e[i] - s[i] == n and h[i] == alone[2][0]


def test_a_hit_of_one_very_long_word(spark):
    word = "w" * D.SLICE
    docs = spark.createDataFrame([(1, word + " tail"), (2, "pre " + word), (3, word[1:])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in D.op9_decontaminate(docs, spark.createDataFrame([(1, word)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_hits_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = ["Ab", "cd", "ÉF", "gh1", "漢字", "x"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(20, ""), (21, None), (3, "unique words only"), (None, "null item words")]
    docs = [(i, text(rng.choice([0, 2, 50, 300]))) for i in range(40)]
    docs += [(50, text(5) + items[4][1] + text(5)), (51, items[3][1].upper()), (52, None), (53, ""), (50, "again"), (None, "a null item words b")]
    docs += [(54, "q" * 3_000_000 + " " + items[5][1]), (55, ("lorem " * 400_000) + items[6][1])]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n_words int, row string")
    bench = spark.createDataFrame([b for b in items if b[0] is not None], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.op9_decontaminate(df, bench).collect())
    want = slow(docs, [b for b in items if b[0] is not None])
    assert got == want
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    clean = sorted(str(d[0]) for d, w in zip(docs, (slow([d], [b for b in items if b[0] is not None])[0] for d in docs)) if not w[5])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean
    cut = D.decontaminate(df, bench, remove="spans")
    assert cut.count() == len(docs) and D.op9_decontaminate(df.filter("doc_id = 53"), bench).first()["n_words"] == 0


def test_a_small_set_still_verifies(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_BITS_LOG2", 20)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"b{i}y{j}" for j in range(3000))) for i in range(60)], "item_id long, text string")
    assert D.op9_decontaminate(docs, bench).filter("contaminated").isEmpty()  # the bitmap lets many through, the words none


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.op9_decontaminate(docs, none).first()["n_hit"] == 0
    assert D.op9_decontaminate(docs.limit(0), none).count() == 0 and D.decontaminate(docs, none).count() == 1
