"""Phrase collocations by dynamic itemset counting.

Chunks of documents are dealt into ``SHARDS`` shards in turn and the shards are scanned in a cycle, one a step. Words are counted
from the first step. A longer phrase is active once the two phrases it overlaps to (all but its last
word, all but its first) have both reached the threshold, whatever step that is, and is then counted through one
full cycle, so phrases of all lengths are counted in the same scan. A scan knows which phrases have
reached the threshold from a bitmap of their hashes, of a fixed size at most. A wrong bit only makes a
phrase count earlier; a count in a shard is a true count whenever it is made, so counts are exact.

Texts are cut into words once: a shard holds, for each of its chunks (``CHUNK`` words of a task), the number of each word in its order,
and the key and name of each number. The scans read those, names only while words can be new.

What the steps find lies in one folder by step, so a plan reads any number of steps by one scan: plans do not grow with the steps.

A phrase is known by a 128-bit key: of its language and text for a word, of the keys of its two overlapping
parts for a longer one. The strings are put together at the end, from the words up, for frequent phrases only.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_bounds, materialize
from narrascope.session import scratch_dir

MIN_COUNT = 100
MAX_WORDS = 5
SHARDS = 3
TOP = 2000
#: bits of each of the two bitmaps, at most (32 MiB)
MAX_BITS_LOG2 = 28
#: words that a task counts together, a quarter of them distinct at most: one row of a shard (whole texts, so one text may exceed it)
CHUNK = 1 << 20
#: chunks that a task of a scan adds up before the shuffle, if all cores have work
TASK_CHUNKS = 12
#: bytes of the row groups of a shard, about; a row has some 12 bytes a word at most
GROUP_BYTES = 16 << 20
#: A-Z become lower case, the characters between pieces a full stop, tabs a space
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b".........\x20")
_SLICE = re.compile(rb"(?s).{1,1048576}[^ .]*")
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def phrase_keys(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Keys (rows of two 64-bit lanes) of the phrases whose parts have the keys ``p`` and ``s``."""
    out = np.empty_like(p)
    for lane in (0, 1):
        a, b, c = _MIX[3 * lane: 3 * lane + 3]
        x = p[:, lane] * a + (s[:, lane] ^ (s[:, lane] >> np.uint64(31))) * b
        x = (x ^ (x >> np.uint64(32))) * c
        out[:, lane] = x ^ (x >> np.uint64(29))
    return out


class Bits:
    """The two bitmaps: phrases that reached the threshold, and those that did within the last cycle."""

    def __init__(self, log2: int, maps: tuple[np.ndarray, np.ndarray]):
        self.log2, self.maps = log2, maps

    def has(self, which: int, keys: np.ndarray) -> np.ndarray:
        at = keys[:, 0] >> np.uint64(64 - self.log2)
        return ((self.maps[which][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


class Chunk:
    """The words of some texts as numbers; -1 stands between pieces."""

    def __init__(self):
        self.number = itertools.count()
        self.words: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        held = self.words.get(lang)
        if held is None:
            held = self.words[lang] = defaultdict(self.number.__next__)
            held[b"."] = -1
        for piece in _SLICE.finditer(text.encode().translate(_FOLD)):
            found = piece[0].replace(b".", b" . ").split()
            self.parts.append(np.fromiter(map(held.__getitem__, found), np.int32, len(found)))
            self.size += len(found)
        self.parts.append(np.array([-1], np.int32))

    def full(self) -> bool:
        return self.size >= CHUNK or sum(map(len, self.words.values())) >= CHUNK // 4

    def row(self, shard: int) -> pa.RecordBatch:
        """The words in order, then per word its key and its name (length of the language, language, word), and the words of each language."""
        ids = np.concatenate(self.parts)
        defs = [b""] * sum(len(held) - 1 for held in self.words.values())
        for lang, held in self.words.items():
            before = f"{len(lang)}:{lang}".encode()
            for w, i in held.items():
                if i >= 0:
                    defs[i] = before + w
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, defs)), ">u8").astype(np.uint64)
        n = np.bincount(ids[ids >= 0], minlength=len(defs))
        sizes = []
        for held in self.words.values():
            mine = np.fromiter(held.values(), np.int64, len(held))
            sizes.append(int(n[mine[mine >= 0]].sum()))
        return pa.RecordBatch.from_pylist([{"ids": ids.astype(np.int32, copy=False).tobytes(), "keys": keys.tobytes(), "defs": defs,
                                            "langs": list(self.words), "sizes": sizes, "shard": shard}], schema=_ENCODED)


def dealer(shards: int):
    """Texts (lang, text, shard of the task's first chunk) to rows of words, for ``mapInArrow``; one chunk is held at a time."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, done, first = Chunk(), 0, 0
        for b in batches:
            for lang, text, first in zip(b.column("lang").to_pylist(), b.column("text"), b.column("shard").to_pylist()):
                chunk.add(lang, text.as_py())
                if chunk.full():
                    yield chunk.row((first + done) % shards)
                    chunk, done = Chunk(), done + 1
        if chunk.size:
            yield chunk.row((first + done) % shards)
    return deal


def counts(ids: np.ndarray, keys: np.ndarray, defs: pa.BinaryArray | None, bits: Bits | None, count_words: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the words, and of the active phrases of every length; definitions of the latest known ones (of words if ``defs`` are given)."""
    if count_words:
        yield _batch(1, keys, np.bincount(ids[ids >= 0], minlength=len(keys)))
    if bits is None:
        return
    known, recent = bits.has(0, keys), bits.has(1, keys)
    if defs is not None:
        told = np.flatnonzero(known & recent)
        yield _batch(1, keys[told], np.zeros(len(told), np.int64), defs.take(pa.array(told)))
    at = np.flatnonzero(ids >= 0)
    at = at[known[ids[at]]]  # where a known phrase of the length below starts
    held, fresh = keys[ids[at]], recent[ids[at]]
    for size in range(2, MAX_WORDS + 1):
        i = np.flatnonzero(at[1:] == at[:-1] + 1)
        new, active = phrase_keys(held[i], held[i + 1]), fresh[i] | fresh[i + 1]
        where = np.flatnonzero(active)
        if len(where):
            code, first = _distinct(new[where])
            first = where[first]
            parts = _parts(held, i[first]) if size == MAX_WORDS else None
            yield _batch(size, new[first], np.bincount(code, minlength=len(first)), parts)
        if size == MAX_WORDS:
            return
        known = bits.has(0, new)
        fresh = known & bits.has(1, new)
        where = np.flatnonzero(fresh)
        if len(where):
            first = where[_distinct(new[where])[1]]
            yield _batch(size, new[first], np.zeros(len(first), np.int64), _parts(held, i[first]))
        at, held, fresh = at[i][known], new[known], fresh[known]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key among the distinct ones, and the first place of each."""
    code, found = pd.factorize(keys[:, 0])
    first = np.empty(len(found), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    if (keys[first, 1][code] != keys[:, 1]).any():
        _, first, code = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return code.reshape(-1), first


def _parts(held: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    """The keys of both parts, 32 bytes each, big-endian."""
    both = np.hstack((held[at], held[at + 1])).astype(">u8")
    ends = np.arange(0, 32 * len(at) + 1, 32, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(both.tobytes())])


ENCODED = "ids binary, keys binary, defs array<binary>, langs array<string>, sizes array<long>, shard int"
_ENCODED = pa.schema([("ids", pa.binary()), ("keys", pa.binary()), ("defs", pa.list_(pa.binary())), ("langs", pa.list_(pa.string())),
                      ("sizes", pa.list_(pa.int64())), ("shard", pa.int32())])
SCHEMA = "k int, h1 long, h2 long, def binary, n long"
_KIND = pa.schema([("k", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("def", pa.binary()), ("n", pa.int64())])
KEYS = "k int, h1 long, h2 long"
LEVEL = "lang string, phrase string, n long, h1 long, h2 long, p1 long, p2 long, s1 long, s2 long, firsts array<long>, rests array<long>"
KEY = ["h1", "h2"]
#: rows of keys that are broadcast, at most (16 bytes each)
SMALL = 500_000


def _batch(k: int, keys: np.ndarray, n: np.ndarray, told: pa.BinaryArray | None = None) -> pa.RecordBatch:
    size = len(n)
    lanes = [pa.array(np.ascontiguousarray(keys[:, x]).view(np.int64)) for x in (0, 1)]
    told = pa.nulls(size, pa.binary()) if told is None else told
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), *lanes, told, pa.array(n.astype(np.int64))], schema=_KIND)


def counter(held, count_words: bool):
    """The scan of one shard, for ``mapInArrow``: counts by row of words, added up by Spark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(*held.value) if held is not None else None
        for b in batches:
            for r in range(b.num_rows):
                ids, keys = (np.frombuffer(b.column(x)[r].as_buffer(), t) for x, t in (("ids", np.int32), ("keys", np.uint64)))
                defs = b.column("defs")[r].values if "defs" in b.schema.names else None
                yield from counts(ids, keys.reshape(-1, 2), defs, bits, count_words)
    return scan


def bitmaps(spark: SparkSession, known: DataFrame, since: int):
    """The broadcast bitmaps of ``known`` (h1, since): all, and those that came at ``since`` or later; how many those are."""
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("since") >= since).alias("recent")).first()
    log2 = min(MAX_BITS_LOG2, max(20, (64 * facts["n"]).bit_length()))
    bit = F.shiftrightunsigned("h1", 64 - log2) + 1
    which = F.explode(F.when(F.col("since") >= since, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = (known.select(which.alias("which"), bit.alias("bit")).groupBy("which", F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())  # at most 2 * 2**28 bits
    maps = tuple(np.zeros(1 << (log2 - 3), dtype=np.uint8) for _ in range(2))
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        maps[r["which"]][at: at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast((log2, maps)), facts["recent"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _of(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` that have one of the ``n`` distinct ``keys``."""
    return rows.join(F.broadcast(keys) if n <= SMALL else keys, KEY, "left_semi")


def _put(df: DataFrame, root: str, part: str, at: int) -> None:
    df.write.parquet(f"{root}/{part}={at}")


def _got(spark: SparkSession, schema: str, root: str, part: str, at: range) -> DataFrame:
    """What ``_put`` wrote at these values of the column ``part``, by one scan."""
    return spark.read.schema(f"{schema}, {part} int").option("basePath", root).parquet(*(f"{root}/{part}={i}" for i in at))


def scan_cycles(docs: DataFrame, min_count: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The counts of every step, the keys (k, h1, h2) of all phrases that reached ``min_count``, and the number of words of each language.

    A phrase that reaches ``min_count`` in the last steps, one for each shard, has an even share of it in one of them, so
    the others are read for such keys alone.
    """
    spark = docs.sparkSession
    path, counted, shared, found = (scratch_dir(spark, f"phrase-{x}") for x in ("shards", "counts", "hot", "known"))
    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.pmod(F.spark_partition_id(), F.lit(shards)).cast("int").alias("shard"))
    # few, wide rows: the writer's bounds are looked at after each, not after each hundred
    sizes = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    with arrow_bounds(spark):
        dealt.mapInArrow(dealer(shards), ENCODED).write.options(**sizes).partitionBy("shard").parquet(path)
    encoded = spark.read.schema(ENCODED).option("basePath", path).parquet(path)
    total = encoded.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("total"))
    tasks = {r["shard"]: max(spark.sparkContext.defaultParallelism, -(-r["count"] // TASK_CHUNKS)) for r in encoded.groupBy("shard").count().collect()}  # one row a shard
    n_hot: list[int] = []
    known = held = None
    with arrow_bounds(spark):
        for step in itertools.count():
            if step:
                # phrases of MAX_WORDS words are parts of none
                held, recent = bitmaps(spark, known.filter(F.col("k") < MAX_WORDS), step - shards)
                if step >= shards and not recent:
                    held.unpersist()
                    return _got(spark, SCHEMA, counted, "step", range(step)), known, total
            # the last words become known at step shards - 1 and are told for a cycle
            shard = encoded.filter(F.col("shard") == step % shards).select("ids", "keys", *["defs"] * (step < 2 * shards))
            rows = shard.coalesce(tasks.get(step % shards, 1)).mapInArrow(counter(held, step < shards), SCHEMA)
            _put(rows.groupBy("k", *KEY, "def").agg(F.sum("n").alias("n")), counted, "step", step)
            if held is not None:
                held.unpersist()
            new = lambda keys: keys if known is None else keys.join(known.select(*KEY), KEY, "left_anti")
            hot = _got(spark, SCHEMA, counted, "step", range(step, step + 1)).filter(F.col("n") >= -(-min_count // shards))
            _put(new(hot.select(*KEY)), shared, "step", step)
            last = range(max(0, step + 1 - shards), step + 1)
            n_hot.append(_got(spark, "h1 long, h2 long", shared, "step", range(step, step + 1)).count())
            keys = new(_got(spark, "h1 long, h2 long", shared, "step", last).select(*KEY).distinct())
            sums = _of(_got(spark, SCHEMA, counted, "step", last), keys, sum(n_hot[i] for i in last)).groupBy("k", *KEY).agg(F.sum("n").alias("n"))
            _put(sums.filter(F.col("n") >= min_count).select("k", *KEY), found, "since", step)
            known = _got(spark, KEYS, found, "since", range(step + 1))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``MAX_WORDS`` words that occur ``min_count`` times or more, and the number of words of each language.

    Phrases: ``lang, phrase, k, n``, the keys, and for each cut the counts of its parts (``firsts``, ``rests``).
    """
    spark = docs.sparkSession
    steps, known, total = scan_cycles(docs, min_count, shards)
    total = materialize(total, "phrase-totals")
    rows = _of(steps.withColumn("shard", F.col("step") % shards), known.select(*KEY), known.count())
    # a shard's count is the same in whichever steps it was made
    once = rows.groupBy("k", *KEY, "shard").agg(F.max("n").alias("n"), F.max("def").alias("def")).groupBy("k", *KEY).agg(F.sum("n").alias("n"), F.max("def").alias("def"))
    part = lambda i: F.when(F.col("k") > 1, F.conv(F.hex(F.substring("def", 8 * i + 1, 8)), 16, -10).cast("long"))
    named = F.when(F.col("k") == 1, F.col("def").cast("string"))
    digits = F.substring_index(named, ":", 1)
    size = digits.try_cast("int")
    counted = materialize(once.select(
        "k", *KEY, "n", part(0).alias("p1"), part(1).alias("p2"), part(2).alias("s1"), part(3).alias("s2"),
        F.substring(named, F.length(digits) + 2, size).alias("lang"), F.substring(named, F.length(digits) + 2 + size, F.length(named)).alias("word")), "phrase-frequent")
    none = F.array().cast("array<long>")
    root = scratch_dir(spark, "phrase-levels")
    _put(counted.filter("k = 1").select("lang", F.col("word").alias("phrase"), "n", *KEY, "p1", "p2", "s1", "s2", none.alias("firsts"), none.alias("rests")), root, "k", 1)
    for k in range(2, MAX_WORDS + 1):
        level = _got(spark, LEVEL, root, "k", range(k - 1, k))
        p = level.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("n").alias("p_n"), F.col("firsts").alias("p_firsts"))
        s = level.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.substring_index("phrase", " ", -1).alias("s_word"), F.col("n").alias("s_n"), F.col("rests").alias("s_rests"))
        _put(counted.filter(F.col("k") == k).drop("lang").join(p, ["p1", "p2"]).join(s, ["s1", "s2"]).select(
            F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "s_word").alias("phrase"), "n", *KEY, "p1", "p2", "s1", "s2",
            F.concat("p_firsts", F.array("p_n")).alias("firsts"), F.concat(F.array("s_n"), "s_rests").alias("rests")), root, "k", k)
    return _got(spark, LEVEL, root, "k", range(1, MAX_WORDS + 1)), total


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest phrases of each language.

    Nulls: a null text is empty, a null language is ``und`` (one language with rows that say so). Repeated rows count each. Long
    texts are read in slices that end with a word, phrases run across them. Ties as the order says: score, count, then the
    phrase's bytes, so ranks are unique. An empty table, or one without frequent phrases, gives no rows. Further columns are
    not read. Scores are exact while 1000 * count * words stays under 10^38.
    """
    phrases, total = frequent_phrases(docs, min_count, shards)
    whole = lambda c: c.cast("decimal(19,0)")
    cuts = phrases.filter("k > 1").join(total, "lang").withColumn("top", whole(F.col("n")) * whole(F.col("total")) * F.lit(1000).cast("decimal(4,0)"))
    scored = F.expr("array_min(transform(sequence(0, k - 2), i -> struct(top div (cast(firsts[i] as decimal(19,0)) * cast(rests[i] as decimal(19,0))) as score, i as i)))")
    c = cuts.withColumn("cut", scored)
    inside = _union([phrases.filter("k > 2").filter(F.col("n") >= part).select(F.col(x).alias("h1"), F.col(y).alias("h2"))
                     for x, y, part in (("p1", "p2", F.try_element_at("firsts", F.lit(-1))), ("s1", "s2", F.try_element_at("rests", F.lit(1))))])
    kept = c.join(inside.distinct(), KEY, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.select("lang", "phrase", F.col("n").alias("a"), F.col("firsts")[F.col("cut.i")].alias("l"), F.col("rests")[F.col("cut.i")].alias("r"),
                      F.col("total").alias("n"), F.col("cut.score").alias("score"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(docs: DataFrame) -> DataFrame:
    """The first 2000 collocations of every language; see ``collocations`` for nulls, ties, repeats and empty tables."""
    return collocations(docs)
