"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.session import scratch_dir

#: bytes of an Arrow batch sent to Python, so that long texts cannot fill a worker
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the planner true sizes.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that do not clash (case-insensitively) with ``taken``."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def bound_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


@contextlib.contextmanager
def arrow_bounds(spark: SparkSession) -> Iterator[None]:
    """As ``bound_arrow`` for what is executed inside; the session's own settings come back after it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    bound_arrow(spark)
    try:
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def arrow_function(ddl: str) -> Callable:
    """Decorator: an Arrow UDF with return type ``ddl``, made when it is called.

    Parsing a type needs a session, which a worker that imports the module does not have.
    """
    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*cols) -> Column:
            return F.arrow_udf(fn, ddl)(*cols)
        return call
    return wrap


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes; a null text has a key of its own (one zero byte)."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("00")))
