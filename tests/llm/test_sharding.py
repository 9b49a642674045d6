"""LPT sharding: groups together, loads near equal, slots without gaps."""

import random
import zlib
from collections import defaultdict

from narrascope.llm import sharding as L


def test_law_of_the_digest(spark):
    rng = random.Random(4)
    texts = ["x" * int(rng.paretovariate(1.1) * 20) + str(i) for i in range(3000)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rows += [(3000 + i, texts[7], "s") for i in range(40)] + [(4000, None, "s"), (4001, None, "s"), (4002, "", "s"), (5, texts[5], "s"), (None, "é", "s")]
    got = L.op6_lpt_sharding(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert len(got) == len(rows)
    size = {(i, t): len((t or "").encode()) + 16 for i, t, _ in rows}
    by_id = dict((i, t) for i, t, _ in rows)
    load, slots, shard_of = defaultdict(int), defaultdict(list), {}
    for r in got:
        t = by_id[r["doc_id"]]
        assert r["size"] == size[r["doc_id"], t] and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = defaultdict(int)
    for i, t, _ in rows:
        groups[t] += size[i, t]
    mean, biggest = sum(load.values()) / 40, max(groups.values())
    assert max(load.values()) <= max(biggest, 1.01 * mean + 16)


def test_plain_heap_agrees_when_every_group_is_a_unit():
    sizes = [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1]
    load, want = defaultdict(int), [0, 0, 0]
    for u, s in L.least_loaded(list(enumerate(sizes)), 3):
        load[s] += sizes[u]
    for x in sizes:
        want[want.index(min(want))] += x
    assert sorted(load.values()) == sorted(want)


def test_one_hot_group_empty_table_and_clashing_column(spark):
    rows = [(i, "same text", "old") for i in range(50)] + [(100 + i, f"t{i}", "old") for i in range(10)]
    out = L.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, group_key string"), 4)
    assert out.columns == ["doc_id", "text", "group_key", "shard"]
    got = out.collect()
    assert len(got) == 60 and len({r["shard"] for r in got if r["text"] == "same text"}) == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.op6_lpt_sharding(none).count() == 0 and L.shard_documents(none).count() == 0


def test_many_shards_stay_even(spark):
    groups = spark.range(60_000).selectExpr("id as k", "cast(100 + pmod(hash(id), 400) as long) as sz")
    placed = L.group_shards(groups, "k", "sz", 1500).join(groups, "k").groupBy("shard").sum("sz").collect()
    loads = [r["sum(sz)"] for r in placed]
    assert len(loads) == 1500 and max(loads) <= 1.3 * sum(loads) / 1500


def test_copies_of_one_text_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_BITS", 3)
    rows = spark.range(500).selectExpr("id as doc_id", "if(id < 400, 0, id) as shard", "id as uid").coalesce(1)
    slots = defaultdict(list)
    for r in L.number_slots(rows).collect():
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 101 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_bundles_against_a_heap_over_all_groups(spark):
    """The heaviest shard is at most a bundle above what LPT over single groups gives."""
    rng = random.Random(12)
    sizes = [int(rng.paretovariate(1.3) * 50) for _ in range(5000)]
    placed = L.group_shards(spark.createDataFrame(list(enumerate(sizes)), "k long, sz long"), "k", "sz", 7).collect()
    got, want = [0] * 7, [0] * 7
    for r in placed:
        got[r["shard"]] += sizes[r["k"]]
    for u, s in L.least_loaded(list(enumerate(sizes)), 7):
        want[s] += sizes[u]
    assert len(placed) == 5000 and sum(got) == sum(sizes) and max(got) <= 1.01 * max(want)
