"""Hierarchical budgets against a recursive version, and the seeded token prefixes."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from narrascope.llm import mixing as M


def slow_fill(kids, budget):
    """kids: name -> (weight, cap)."""
    out, open_ = {}, {k: wc for k, wc in kids.items() if wc[0] > 0}
    out = dict.fromkeys(kids, 0)
    left = budget
    while open_:
        w = sum(x[0] for x in open_.values())
        full = [k for k, (a, c) in open_.items() if left * a >= c * w]
        if not full:
            for k, (a, _) in open_.items():
                out[k] = a * left // w
            break
        for k in full:
            out[k] = open_[k][1]
        left -= sum(open_.pop(k)[1] for k in full)
    return out


def test_shortages_go_to_siblings_before_ancestors(spark):
    rng = random.Random(9)
    leaves = [(d, l, s, 5, rng.randint(0, 4000)) for d in "abc" for l in "xy" for s in "pqr"]
    weights = {"domain": {"a": 3, "b": 0}, "lang": {"x": 2}, "source": {"p": 5, "q": 0}}
    w = lambda level, name: weights[level].get(name, 1)
    for budget in (0, 100, 7000, 20_000, 10**6):
        df = spark.createDataFrame(leaves, "domain string, lang string, source string, n long, supply long")
        got = {(r["domain"], r["lang"], r["source"]): r["alloc"] for r in M.leaf_budgets(df, F.lit(budget).cast("long"), weights, 2).collect()}
        cap = lambda d=None, l=None: sum(2 * x[4] for x in leaves if d in (None, x[0]) and l in (None, x[1]) and w("domain", x[0]) * w("lang", x[1]) * w("source", x[2]))
        top = slow_fill({d: (w("domain", d), cap(d)) for d in "abc"}, budget)
        for d in "abc":
            mid = slow_fill({x: (w("lang", x), cap(d, x)) for x in "xy"}, top[d])
            for x in "xy":
                low = slow_fill({y[2]: (w("source", y[2]), 2 * y[4]) for y in leaves if y[:2] == (d, x)}, mid[x])
                for s in "pqr":
                    assert got[d, x, s] == (low[s] if w("domain", d) else 0)


def test_prefix_of_seeded_epochs(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), 1) for i in range(900)]
    rows += [(900, None, "en", "src0", 1), (900, None, "en", "src0", 1), (None, "a b c", "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cut int")
    out = M.mix(df, budget_permille=1300, max_epochs=3)
    assert out.columns == [*df.columns, "mix_domain", "mix_tokens", "mix_epoch"]
    got = out.collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    taken = sum(r["mix_tokens"] for r in got)
    assert 0.95 * 1.3 * total <= taken <= 1.3 * total
    seen = defaultdict(set)
    for r in got:
        seen[r["doc_id"], r["text"]].add(r["mix_epoch"])
    assert all(e == set(range(len(e))) for e in seen.values())  # whole epochs first
    again = M.mix(df.repartition(7), budget_permille=1300, max_epochs=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df, budget_permille=1000, max_epochs=1, weights={}).count() >= 0.97 * len(rows)
