"""Line deduplication against levelled sorted runs of line hashes.

Documents arrive in batches of ascending ``doc_id``. A line's key (stripped, ASCII lower case) is kept as
a 128-bit hash. The store holds sorted runs: tables of (hash, owner), bucketed and sorted by the hash,
so a batch's keys, shuffled once by hash, merge-join every run without moving it. Keys that no run
has are the batch's own, written as a new run of level 0; when a level holds ``FANOUT`` runs they are
compacted into one run of the next level, so a batch meets O(log batches) runs. Runs share no keys,
so the owner found is the smallest document that holds the key.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_function, bound_arrow, fresh, materialize

MIN_POINTS = 10
FANOUT = 3
BATCHES = 4
NO_ID = (1 << 63) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HASH = ["h1", "h2"]


def line_key(line: bytes, min_points: int = MIN_POINTS) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a key of under ``min_points`` code points."""
    key = line.strip()
    if len(key) < min_points or len(key) < 4 * min_points and len(key.decode()) < min_points:
        return None
    return xxhash.xxh3_128_digest(key)


LINES = "array<struct<h1:long,h2:long,pos:array<int>>>"


@arrow_function(LINES)
def line_keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct keys of a text and the lines that have each."""
    kind = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.list_(pa.int32()))]))
    whole = lambda b: int.from_bytes(b, "little", signed=True)
    for texts in batches:
        out = []
        for t in texts:
            seen: dict[bytes, list[int]] = {}
            for i, line in enumerate((t.as_py() or "").encode().translate(_LOWER).split(b"\n")):
                key = line_key(line)
                if key is not None:
                    seen.setdefault(key, []).append(i)
            out.append([{"h1": whole(k[:8]), "h2": whole(k[8:]), "pos": p} for k, p in seen.items()])
        yield pa.array(out, kind)


class LineRuns:
    """The store: levels of runs (table names), written in the session's warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def runs(self) -> list[DataFrame]:
        return [self._run(t) for level in reversed(self.levels) for t in level]

    def _run(self, table: str) -> DataFrame:
        return self.spark.table(table).filter("own").select(*HASH, "owner")

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.written}"
        self.written += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(table)
        return table

    def add(self, keys: DataFrame) -> DataFrame:
        """Anti-join a batch's ``h1, h2, low, high`` (smallest and largest document) with the runs, keep what is new.

        Returns ``h1, h2, owner`` of the batch's keys that are in more than one document so far.
        """
        met = keys
        owners = []
        for i, run in enumerate(self.runs()):
            met = met.join(run.withColumnRenamed("owner", f"o{i}"), HASH, "left")
            owners.append(F.col(f"o{i}"))
        old = F.coalesce(*owners) if owners else F.lit(None).cast("long")
        table = self._write(met.select(*HASH, F.coalesce(old, F.col("low")).alias("owner"), old.isNull().alias("own"),
                                       (old.isNotNull() | (F.col("low") < F.col("high"))).alias("shared")))
        self.levels = self.levels or [[]]
        self.levels[0].append(table)
        self.compact()
        return self.spark.table(table).filter("shared").select(*HASH, "owner")

    def compact(self) -> None:
        """Merge the runs of every full level into one run of the next."""
        for n in range(len(self.levels)):
            if len(self.levels[n]) >= self.fanout:
                rows = None
                for t in self.levels[n]:
                    rows = self._run(t) if rows is None else rows.unionByName(self._run(t))
                merged = self._write(rows.repartition(self.buckets, *HASH).select(*HASH, "owner", F.lit(True).alias("own")))
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(merged)
                self.levels[n] = []


def owner_order(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))


def batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Upper ``doc_id`` bounds of the batches but the last, by approximate quantiles."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``owner, key, gone``: per document (id, text digest) the lines that a smaller id holds already."""
    spark = docs.sparkSession
    bound_arrow(spark)
    store = LineRuns(spark)
    rows = docs.select(owner_order(docs).alias("d"), "text")
    edges = batch_edges(docs, batches) if batches > 1 else []
    out = []
    for low, high in zip([None, *edges], [*edges, None]):
        batch = rows
        batch = batch.filter(F.col("d") > low) if low is not None else batch
        batch = batch.filter(F.col("d") <= high) if high is not None else batch
        lines = batch.select("d", F.xxhash64("text").alias("key"), F.explode(line_keys("text")).alias("l")).select("d", "key", "l.*")
        lines = materialize(lines, "line-batch")
        keys = lines.groupBy(*HASH).agg(F.min("d").alias("low"), F.max("d").alias("high"))
        shared = materialize(store.add(keys), "line-shared")  # off the buckets, so that a hot line can be split
        gone = lines.join(shared, HASH).filter(F.col("owner") < F.col("d"))
        out.append(gone.groupBy("d", "key").agg(F.flatten(F.collect_set("pos")).alias("gone")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return materialize(found, "line-gone")


@arrow_function("string")
def keep_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(texts.to_pylist(), gone.to_pylist()):
        drop = set(g or [])
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if drop else t)
    return pa.array(out, pa.string())


@arrow_function("struct<n_lines:long,kept_sha256:string>")
def digest_kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
    n, sha = [], []
    for t, g in zip(texts.to_pylist(), gone.to_pylist()):
        lines, drop = (t or "").split("\n"), set(g or [])
        n.append(len(lines))
        sha.append(hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in drop).encode()).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["n_lines", "kept_sha256"])


def _with_gone(docs: DataFrame, batches: int) -> tuple[DataFrame, str]:
    d, key, gone, k_d, k_key = fresh(docs.columns, "line_owner", "line_text", "line_gone", "gone_owner", "gone_text")
    drops = dropped_lines(docs, batches).toDF(k_d, k_key, gone)
    keyed = docs.withColumn(d, owner_order(docs)).withColumn(key, F.xxhash64("text"))
    return keyed.join(drops, (F.col(d) == F.col(k_d)) & (F.col(key) == F.col(k_key)), "left"), gone


def drop_repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all rows and columns stay.

    Null texts stay null. Rows without ``doc_id`` come last, as one document, so they keep a line only if no
    row with an id has it. Repeated rows of one id are one document and keep the same lines.
    """
    out, gone = _with_gone(docs, batches)
    return out.select(*[keep_lines(F.col("text"), F.col(gone)).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op10_line_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row; null and empty texts are one empty line."""
    out, gone = _with_gone(docs, batches)
    r = out.select("doc_id", F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias("n_gone"), digest_kept(F.col("text"), F.col(gone)).alias("r"))
    return r.select("doc_id", "r.n_lines", F.greatest("n_gone", F.lit(0)).alias("n_dropped"), "r.kept_sha256")
