"""Helpers shared by the operators: checked broadcast, joins on hot keys, lineage cuts."""

from __future__ import annotations

import contextlib
import gc
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is measured to hold at most this many bytes (as JSON text).
BROADCAST_MAX_BYTES = 32 << 20
#: Beyond that, the other side's rows of one key are spread over this many tasks.
SPREAD = 16
#: partitions a core for rows that hold texts
SPREAD_TASKS = 4


def measured_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as JSON text, by one aggregation."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0


def fits_broadcast(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_MAX_BYTES


def sized_broadcast(df: DataFrame) -> DataFrame:
    """``broadcast(df)`` if it is measured to be small, else ``df`` unchanged."""
    return F.broadcast(df) if fits_broadcast(df) else df


def join_on_hot_key(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a lookup table on ``key``, whose most frequent values may hold a large part of ``rows``.

    A small table is broadcast. A larger one is copied ``SPREAD`` times under a salt, and the rows of each
    key are dealt over the copies, so no task gets all rows of one key. Null keys match nothing and are
    dealt like any other. ``how`` is inner, left, left_semi or left_anti.
    """
    if fits_broadcast(side):
        return rows.join(F.broadcast(side), key, how)
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


@contextlib.contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of what is executed inside hold at most so many rows and about so many bytes."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, str(v))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


#: per thread, the open scopes of ``scratch``: each a list of (session, checkpoint file)
_SCOPES = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut_lineage`` writes inside is deleted at the end, so that a long run does not keep every intermediate on disk.

    Nothing that reads such a table may be executed after that. The shuffle files of what went go with the next
    garbage collection, which is asked for.
    """
    open_scopes = _SCOPES.__dict__.setdefault("open", [])
    open_scopes.append(files := [])
    try:
        yield
    finally:
        open_scopes.pop()
        for path in files:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, up: int | None = 0) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``.

    Survives executor loss (unlike a local checkpoint); the folder comes from
    the session and is only invented in local mode. It lives as long as the innermost ``scratch``, or the one ``up``
    levels above it; with None, or outside of them, as long as the session.
    """
    from narrascope.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    scopes = _SCOPES.__dict__.get("open", [])
    if up is not None and len(scopes) > up:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            scopes[-1 - up].append(file.get())
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over several partitions a core, which are not merged again.

    Left alone, a join's output is merged to one partition a core, and the one with the longest texts is waited for.
    Both sides of a join are dealt so, else it may deal both anew.
    """
    return df.repartition(SPREAD_TASKS * df.sparkSession.sparkContext.defaultParallelism, *keys)
