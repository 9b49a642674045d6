"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over token windows.

Windows of the benchmark items become a hash set with a fixed bound: bit positions in a bitmap of at
most ``2**MAX_BITS_LOG2`` bits (64 MiB), sized to 64 bits per window below that. Each text is split
into words with vectorised byte operations, rolling hashes of its windows are looked up in the
bitmap, and the few windows that pass leave the scan with their words. A join on the words themselves
verifies them against the whole window table, which is never broadcast unless the planner knows it to
be small. A larger benchmark makes the bitmap less selective, never the result less exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_function, bound_arrow, fresh, materialize, text_key

WINDOW = 10
MAX_BITS_LOG2 = 29
SLICE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte base and of its inverse modulo 2**64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(SLICE + 1, dtype=np.uint64)
            p[0], n = 1, 1
            while n <= SLICE:
                m = min(n, SLICE + 1 - n)
                p[n: n + m] = p[:m] * np.uint64(pow(base, n, 1 << 64))
                n += m
            _POWERS.append(p)
    return _POWERS[0], _POWERS[1]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word in lower-cased UTF-8 bytes, in memory linear in a slice."""
    up, down = _powers()
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        part = np.frombuffer(data, dtype=np.uint8, count=min(SLICE, len(data) - at), offset=at)
        inside = _WORD[part]
        more = at + len(part) < len(data)
        if len(part) == SLICE and inside.all():  # a word of a slice or more is hashed alone, wherever it stands
            end = at + SLICE
            while end < len(data) and _WORD[data[end]]:
                end += 1
            starts.append(np.array([at])), ends.append(np.array([end]))
            hashes.append(np.array([int.from_bytes(_long_hash(data[at:end]), "little")], dtype=np.uint64))
            at = end
            continue
        if more and inside[-1]:  # end the slice before a word that goes on
            gap = np.flatnonzero(~inside)
            part, inside = part[: gap[-1] + 1], inside[: gap[-1] + 1]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        s, e = edges[::2], edges[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])))
        h = (total[e] - total[s]) * down[s]
        h ^= h >> np.uint64(29)
        starts.append(s + at), ends.append(e + at), hashes.append(h * np.uint64(_STEP))
        at += len(part)
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    return join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)


def _long_hash(word: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(word, digest_size=8).digest()


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + h[j: j + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(_STEP)


def _normal(text) -> bytes:
    return (text.as_py() or "").encode().translate(_LOWER)


ITEM_WINDOWS = "array<struct<len:int,h:long,words:string>>"


@arrow_function(ITEM_WINDOWS)
def item_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("len", pa.int32()), ("h", pa.int64()), ("words", pa.string())]))
    for texts in batches:
        out = []
        for t in texts:
            data = _normal(t)
            s, e, h = words_of(data)
            size = min(WINDOW, len(s))
            seen = {}
            for i, x in enumerate(window_hashes(h, size).view(np.int64).tolist() if size else []):
                seen[b" ".join(data[a:b] for a, b in zip(s[i: i + size], e[i: i + size])).decode()] = x
            out.append([{"len": size, "h": x, "words": w} for w, x in seen.items()])
        yield pa.array(out, kind)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct ``(item_id, len, h, words)`` of the benchmark; items without words have none."""
    bound_arrow(benchmark.sparkSession)
    w = benchmark.select("item_id", F.explode(item_windows("text")).alias("w"))
    return materialize(w.select("item_id", "w.len", "w.h", "w.words").distinct(), "bench-windows")


def hash_set(spark: SparkSession, windows: DataFrame):
    """The broadcast bitmap, its size in bits (log 2) and the window lengths in use."""
    facts = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    log2 = min(MAX_BITS_LOG2, max(20, (64 * facts["n"]).bit_length()))
    bit = F.shiftrightunsigned("h", 64 - log2)
    rows = (windows.select(bit.alias("b")).distinct()
            .groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("bits")).toLocalIterator())
    bitmap = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for r in rows:  # at most 2**MAX_BITS_LOG2 / 32768 rows of 4 KiB
        at = (r["k"] - 1) * 4096
        bitmap[at: at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(bitmap), log2, sorted(facts["lens"])


SCAN = "struct<n_words:long,near:array<struct<pos:int,len:int,words:string,start:int,stop:int>>>"


def scanner(bitmap, log2: int, lens: list[int]):
    """A UDF: the number of words of a text and its windows whose hash is in the set."""
    near_kind = pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32()), ("words", pa.string()),
                                    ("start", pa.int32()), ("stop", pa.int32())]))

    @F.arrow_udf(SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, shift = bitmap.value, np.uint64(64 - log2)
        for texts in batches:
            counts, near = [], []
            for t in texts:
                data = _normal(t)
                s, e, h = words_of(data)
                found = []
                for size in lens:
                    bit = window_hashes(h, size) >> shift
                    for i in np.flatnonzero((held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).tolist():
                        words = b" ".join(data[a:b] for a, b in zip(s[i: i + size], e[i: i + size])).decode()
                        found.append({"pos": i, "len": size, "words": words, "start": int(s[i]), "stop": int(e[i + size - 1])})
                counts.append(len(s)), near.append(found)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(near, near_kind)], ["n_words", "near"])

    return scan


def verified_hits(docs: DataFrame, benchmark: DataFrame, *keys) -> tuple[DataFrame, DataFrame]:
    """All rows (``row``, keys, ``n_words``) and their verified windows (``row``, pos, len, start, stop, item_id)."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark)
    bitmap, log2, lens = hash_set(spark, windows)
    bound_arrow(spark)
    scan = scanner(bitmap, log2, lens)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), *keys, scan("text").alias("r"))
                       .select("*", "r.n_words", "r.near").drop("r"), "decontam-scan")
    near = rows.filter(F.size("near") > 0).select("row", F.explode("near").alias("w")).select("row", "w.*")
    return rows.drop("near"), near.join(windows.select("item_id", "words", "len"), ["words", "len"]).drop("words")


def covered(spans: Column) -> Column:
    """Number of words under a set of (pos, len) windows."""
    s = F.array_sort(spans)
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["upto"], x["pos"] + x["len"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["upto"], x["pos"]))).cast("long").alias("n"))
    return F.aggregate(s, zero, step, lambda a: a["n"])


def op9_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    Null and empty texts have no words and no hits; items without words match nothing; repeated items
    count once, and items without id count as hits but not among the items; repeated documents are each
    returned. Long texts are scanned in slices, words of any length whole. Columns besides the named ones are
    not read, whatever their names.
    """
    rows, hits = verified_hits(docs, benchmark, F.col("doc_id"))
    per = hits.groupBy("row").agg(covered(F.collect_set(F.struct("pos", "len"))).alias("n_hit"),
                                  F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without contamination: ``remove="documents"`` drops every document with a verified
    window, ``remove="spans"`` cuts the windows (merged, by bytes) out of the texts and keeps the rows.

    Contamination depends on the text alone, so rows are matched by text digest: repeated rows and null
    ids need no row identity.
    """
    key, cuts = fresh(docs.columns, "text_sha", "text_cuts")
    rows, hits = verified_hits(docs, benchmark, text_key(F.col("text")).alias("k"))
    bad = hits.join(rows.select("row", "k"), "row")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    if remove == "documents":
        return keyed.join(materialize(bad.select(F.col("k").alias(key)).distinct(), "decontam-bad"), key, "left_anti").select(*docs.columns)
    spans = bad.groupBy(F.col("k").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(cuts))
    out = keyed.join(spans, key, "left")
    return out.select(*[F.when(F.col(cuts).isNull(), F.col(c)).otherwise(cut_spans("text", cuts)).alias(c) if c == "text" else F.col(c)
                        for c in docs.columns])


@arrow_function("string")
def cut_spans(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    out = []
    for t, c in zip(texts.to_pylist(), cuts.to_pylist()):
        data, parts, at = (t or "").encode(), [], 0
        for x in c or []:
            parts.append(data[at: x["start"]])
            at = max(at, x["stop"])
        out.append(b"".join([*parts, data[at:]]).decode() if t is not None else None)
    return pa.array(out, pa.string())
