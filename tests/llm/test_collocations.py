"""Collocations against plain counting of every phrase."""

import random
import re
from collections import Counter

from narrascope.llm import collocations as C


def plain(rows, min_count, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                count.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cands = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cands.items():
        longer = [q for q in cands if q[0] == lang and len(q[1]) > len(p) and any(q[1][i:i + len(p)] == p for i in range(len(q[1]) - len(p) + 1))]
        if any(100 * cands[q] >= 100 * a for q in longer):
            continue
        score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return ranked


def texts(rng):
    pool = ["new york city hall", "New York", "of the", "the", "a b", "x", "naïve Ünder", "san\tfrancisco bay", "one two three four five six", "ha ha ha ha"]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", ", ", ".", "\n", "\x1c", "\r\n", "?!"]) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "seul")] + [("de", "copied text here again")] * 30


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_equals_plain_counting(spark, monkeypatch):
    rows = texts(random.Random(6))
    df = spark.createDataFrame([(i, *r, 1, "w") for i, r in enumerate(rows)], "doc_id long, lang string, text string, k int, word string").repartition(4)
    want = sorted(plain(rows, 8, 40))
    assert len(want) > 10 and got(C.collocations(df, 8, 40, 3)) == want
    bits = C.bitmaps
    monkeypatch.setattr(C, "bitmaps", lambda s, k, since: crowded(s, *bits(s, k, since)))
    assert got(C.collocations(df, 8, 2000, 1)) == sorted(plain(rows, 8, 2000))


def crowded(spark, held, recent):
    """The same bitmaps with every second phrase known wrongly."""
    log2, maps = held.value
    return spark.sparkContext.broadcast((log2, tuple(m | 0x55 for m in maps))), recent


def test_long_text_and_exact_scores(spark):
    rows = [("en", "big deal " * 200_000), ("en", "w" * 2_000_000 + " big deal")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(C.collocations(df, 100, 2000, 1)) == sorted(plain(rows, 100, 2000))


def test_plans_do_not_grow_with_steps(spark, monkeypatch):
    """What all steps counted is read by one scan, and phrases of five words need no cycle after they are counted."""
    scans, steps, of, bits = [], [], C._of, C.bitmaps
    monkeypatch.setattr(C, "_of", lambda rows, *a: scans.append(rows._jdf.queryExecution().analyzed().toString().count("Relation [")) or of(rows, *a))
    monkeypatch.setattr(C, "bitmaps", lambda s, k, since: steps.append(since) or bits(s, k, since))
    rows = [("en", "one two three four five")] * 60 + [(None, "one two three four five six")] * 50
    assert got(C.collocations(spark.createDataFrame(rows, "lang string, text string"), 40, 2000, 2)) == sorted(plain(rows, 40, 2000))
    assert set(scans) == {1}
    scans.clear()
    steps.clear()
    C.collocations(spark.createDataFrame(rows, "lang string, text string"), 40, 2000, 1)
    assert set(scans) == {1} and len(steps) == 5


def test_key_parts_of_all_64_bits(spark):
    """A part's key is read back as it was, the sign too."""
    keys = C.np.array([[1, 2**63], [2**64 - 1, 7], [2**63 - 1, 0], [2**31, 2**63 + 5]], C.np.uint64)
    df = spark.createDataFrame([(bytes(x),) for x in C._parts(keys, C.np.arange(3)).to_pylist()], "def binary")
    read = [tuple(r) for r in df.select(*(C.F.conv(C.F.hex(C.F.substring("def", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(4))).collect()]
    assert read == [tuple(C.np.concatenate((keys[i], keys[i + 1])).view(C.np.int64).tolist()) for i in range(3)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert C.op12_collocations(none).count() == 0
    assert C.op12_collocations(spark.createDataFrame([("en", "too few words")], "lang string, text string")).count() == 0
