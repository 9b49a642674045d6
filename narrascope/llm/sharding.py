"""Longest-processing-time sharding of document groups.

Groups that must stay together (here: equal texts) are sorted by size and go to the least-loaded
shard through a heap. The heap is sequential, so it must not see one entry per group: the groups,
in descending size order, are first bundled along their running byte total. Level ``k`` of the
bundling covers the stretch from ``1 - 2**-k`` to ``1 - 2**-(k+1)`` of all bytes and is cut into
``units_per_level`` stretches, so bundles shrink towards the tail and the last ones even out what
the first ones left. A group larger than a bundle is a bundle of its own. A level has ``UNITS_PER_SHARD``
bundles a shard, 256 at least, so there are at most ``MAX_LEVEL * (max(256, UNITS_PER_SHARD * shards) + 1)``
bundles whatever the input, a proven bound, and these go through the heap on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.common import fresh, materialize, text_key

ROW_OVERHEAD = 16
MAX_LEVEL = 31
UNITS_PER_SHARD = 8
#: rows that are numbered together: 2 ** 14 of one task, however many copies a text has
CHUNK_BITS = 14


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the per-document overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def least_loaded(units: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """(unit, size) pairs, largest first, each to the least-loaded shard (ties: smaller shard)."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append((unit, shard))
    return out


def group_shards(groups: DataFrame, key: str, size: str, shards: int, units_per_level: int | None = None) -> DataFrame:
    """``key`` and ``shard`` of each group (one row per group), by LPT over bundles.

    The running byte total is a distributed prefix sum: range partitions of the sorted groups,
    a window inside each, and the sums of the partitions before it.
    """
    spark = groups.sparkSession
    units_per_level = units_per_level or max(256, UNITS_PER_SHARD * shards)
    g = groups.select(F.col(key).alias("k"), F.col(size).cast("long").alias("sz"))
    ranged = materialize(g.repartitionByRange(F.desc("sz"), F.col("k")).withColumn("part", F.spark_partition_id()),
                         "lpt-groups")
    parts = ranged.groupBy("part").agg(F.sum("sz").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"),
                                       F.greatest(F.sum("total").over(Window.partitionBy()), F.lit(1)).alias("all")), "lpt-offsets")
    inside = Window.partitionBy("part").orderBy(F.desc("sz"), "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = (ranged.withColumn("run", F.coalesce(F.sum("sz").over(inside), F.lit(0)))
            .join(offsets, "part")
            .withColumn("start", F.col("run") + F.col("offset")))
    left = F.greatest(F.col("all") - F.col("start"), F.lit(1))
    rows = rows.withColumn("level", F.least(F.lit(MAX_LEVEL - 1), F.floor(F.log2(F.col("all") / left))).cast("int"))
    head = F.col("all") * (1 - F.pow(F.lit(2.0), -F.col("level")))
    width = F.col("all") / F.pow(F.lit(2.0), F.col("level") + 1) / units_per_level
    slot = F.greatest(F.lit(0), F.least(F.lit(units_per_level), F.floor((F.col("start") - head) / width)))
    rows = materialize(rows.select("k", "sz", (F.col("level") * (units_per_level + 1) + slot).cast("int").alias("unit")),
                       "lpt-units")
    units = [(r["unit"], r["size"]) for r in rows.groupBy("unit").agg(F.sum("sz").alias("size")).collect()]
    placed = spark.createDataFrame(least_loaded(units, shards), "unit int, shard int")
    return rows.join(F.broadcast(placed), "unit").select(F.col("k").alias(key), "shard")


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """``docs`` with a ``shard`` column; rows with equal texts share a shard.

    Null texts form one group, empty texts another. Repeated rows are kept. A table without rows
    gives no rows. An existing column called ``shard`` is replaced. One group with more than a
    shard's fair part of all bytes still stays together, so its shard is larger than the others.
    """
    k, sz, shard = fresh(docs.columns, "group_key", "group_size", "group_shard")
    keyed = docs.withColumn(k, text_key(F.col(text)))
    groups = keyed.groupBy(k).agg(F.sum(document_size(F.col(text))).alias(sz))
    placed = group_shards(groups, k, sz, shards).withColumnRenamed("shard", shard)
    out = keyed.join(placed, k)
    return out.select(*[docs[c] for c in docs.columns if c.lower() != "shard"], F.col(shard).alias("shard"))


def number_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard.

    Numbers are given inside (chunk of a task's rows, shard) and offset by the counts of the chunks before, so
    no task holds a whole shard, or all copies of a text.
    """
    uid, chunk, n, off = fresh(rows.columns, "uid", "chunk", "n_rows", "slot_offset")
    held = materialize(rows.withColumn(uid, F.monotonically_increasing_id()), "shard-rows").withColumn(chunk, F.shiftright(uid, CHUNK_BITS))
    counts = held.groupBy(chunk, shard).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(chunk, shard, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    inside = Window.partitionBy(chunk, shard).orderBy(uid)
    numbered = held.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    return (numbered.join(offsets, [chunk, shard])
            .withColumn("slot", F.col("slot") + F.col(off)).drop(uid, chunk, off))


def op6_lpt_sharding(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The digest rows of the contract: shard and slot of every document under the ``bytes`` law.

    Null texts form one group (size 16 each), empty texts another; rows without id and repeated rows are placed each. Equal
    sizes go in the order of the text's digest, equal loads to the smaller shard. A table without rows gives none. Texts of
    any length count whole; columns besides ``doc_id`` and ``text`` are not read, whatever their names.
    """
    digest = docs.select("doc_id", document_size(F.col("text")).alias("size"),
                         F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                         text_key(F.col("text")).alias("k"))
    groups = digest.groupBy("k").agg(F.sum("size").alias("group_size"))
    placed = group_shards(groups, "k", "group_size", shards)
    rows = number_slots(digest.join(placed, "k").drop("k"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
