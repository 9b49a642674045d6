"""SimHash near-duplicate classes over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so
they share at least six positional bytes. Single (position, byte) postings hold 1/256 of all
fingerprints each, which no join survives, so postings are keyed by four positional bytes: two of the
four 16-bit blocks, six keys per fingerprint, and two bits leave at least two blocks untouched. Pairs
that meet in a posting are tallied over all eight byte positions, those under the guaranteed six
matches are dropped, and the Hamming distance verifies the rest.

A posting with more than ``MAX_POSTING`` fingerprints (a large family of near copies) is not paired.
Its fingerprints are linked exactly through shared one-bit neighbours instead: two of them are
within two bits if and only if some 64-bit value is within one bit of both, and at most 65 fingerprints
can share such a value, so every group there is small whatever the size of the family.

Equal fingerprints are one node throughout; classes are connected components, found by rounds of
minimum labels with pointer jumping over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_function, bound_arrow, fresh, materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
BYTES = 8
MAX_POSTING = 32
HASH_SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text's word shingles (null, empty or wordless: 0)."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest, seed = xxhash.xxh64_intdigest, HASH_SEED
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: 1 - k].tolist(), ends[k - 1:].tolist())],
                          dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


@arrow_function("long")
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(0xFF) == 0, 1).otherwise(0) for i in range(BYTES)), F.lit(0))


def links(nodes: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """Edges ``(a, b)``, a < b, that connect exactly the ``fp`` values within two bits of each other.

    ``nodes`` holds distinct fingerprints. Within large families the edges are a subset of the links
    with the same connected components.
    """
    pairs = list(combinations(range(4), 2))
    combo = F.explode(F.array(*[
        F.struct(F.lit(n).alias("combo"), F.shiftleft(_block(F.col("fp"), i), 16).bitwiseOR(_block(F.col("fp"), j)).alias("bytes"))
        for n, (i, j) in enumerate(pairs)]))
    postings = nodes.select("fp", combo.alias("p")).select("fp", "p.combo", "p.bytes")
    sizes = postings.groupBy("combo", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(postings.join(sizes, ["combo", "bytes"]), "simhash-postings")
    small = shared.filter(F.col("n") <= max_posting)
    left, right = small.select("combo", "bytes", F.col("fp").alias("a")), small.select("combo", "bytes", F.col("fp").alias("b"))
    first = F.coalesce(*[F.when((_block(F.col("a"), i) == _block(F.col("b"), i)) & (_block(F.col("a"), j) == _block(F.col("b"), j)), n)
                         for n, (i, j) in enumerate(pairs)])
    met = left.join(right, ["combo", "bytes"]).filter((F.col("a") < F.col("b")) & (F.col("combo") == first))
    kept = met.filter(shared_bytes(F.col("a"), F.col("b")) >= BYTES - MAX_BITS)
    verified = kept.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    family = shared.filter(F.col("n") > max_posting).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    near = family.select("fp", F.explode(flips).alias("c"))
    star = near.withColumn("a", F.min("fp").over(Window.partitionBy("c"))).filter(F.col("a") < F.col("fp"))
    return verified.unionByName(star.select("a", F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node with an edge; ``comp`` is the smallest node of its component.

    Each round every node takes the least label among its neighbours and then the label of that label; it
    ends when no label changes, and a label only ever falls, so it does end.
    """
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                       .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), "cc-edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), "cc-labels")
    while True:
        offered = (both.join(labels.select(F.col("node").alias("other"), "comp"), "other")
                   .groupBy("node").agg(F.min("comp").alias("low")))
        hooked = labels.join(offered, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        stepped = materialize(hooked.join(jump, "mid").select("node", F.least("mid", "top").alias("comp"), "old"), "cc-labels")
        labels = stepped.select("node", "comp")
        if stepped.filter("comp <> old").isEmpty():
            return labels


def labelled_classes(digest: DataFrame) -> DataFrame:
    """``(fp, comp, component_id)`` for each distinct ``fp`` of ``digest`` (doc_id, fp); ``comp`` tells classes apart."""
    nodes = materialize(digest.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comp = components(links(nodes.select("fp")))
    labelled = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lowest = labelled.groupBy("comp").agg(F.min("low").alias("component_id"))
    return labelled.join(lowest, "comp").select("fp", "comp", "component_id")


def classes(digest: DataFrame) -> DataFrame:
    """``(fp, component_id)`` for each distinct ``fp`` of ``digest`` (doc_id, fp)."""
    return labelled_classes(digest).select("fp", "component_id")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` of every row, written."""
    bound_arrow(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("fp")), "simhash-fp")


def op5_simhash(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Null, empty and wordless texts have fingerprint 0, linked like any other. Null ids take part in the
    links but are never a component's id, which is null only if all its ids are. Repeated rows are all returned.
    """
    digest = fingerprint_digest(docs)
    return digest.join(classes(digest), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per class: a row with the class's smallest ``doc_id``.

    Of repeated rows with that id one stays, of different fingerprints with that id in the class the
    smallest. Rows without an id stay only where their whole class has none, one for each class.
    """
    digest = fingerprint_digest(docs)
    found = digest.join(labelled_classes(digest), "fp")
    verdict = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("low"),
                                                      (F.min("fp") != F.max("fp")).alias("mixed")), "simhash-verdict")
    gone, fp, cls = fresh(docs.columns, "gone_id", "near_fp", "near_class")
    drops = verdict.filter(F.col("doc_id").isNotNull() & ((F.col("low") != F.col("doc_id")) | F.col("mixed"))).select(F.col("doc_id").alias(gone))
    # the ids to drop grow with the documents: one plan at every size
    kept = docs.filter("doc_id is not null").join(drops.hint("merge"), F.col("doc_id") == F.col(gone), "left_anti")
    if not verdict.filter("doc_id is not null and n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    mixed = verdict.filter("doc_id is not null and mixed").select("doc_id")
    if not mixed.isEmpty():  # ids on several texts: decided by id and fingerprint
        first = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("comp").agg(F.min(F.struct("doc_id", "fp")).alias("x"))
        first = first.select("x.*").join(mixed, "doc_id", "left_semi")
        first = materialize(first.select(F.col("doc_id").alias(gone), F.col("fp").alias(fp)), "simhash-mixed")
        some = docs.join(first.select(gone).distinct(), F.col("doc_id") == F.col(gone), "left_semi").withColumn(cls, fingerprints("text"))
        some = some.join(first, (F.col("doc_id") == F.col(gone)) & (F.col(cls) == F.col(fp)), "left_semi").dropDuplicates(["doc_id", cls])
        kept = kept.unionByName(some.select(*docs.columns))
    if verdict.filter("doc_id is null").isEmpty():
        return kept
    alone = materialize(classes_without_ids(digest).toDF(fp, cls), "simhash-anon")
    rest = docs.filter("doc_id is null").withColumn(fp, fingerprints("text")).join(alone, fp).dropDuplicates([cls])
    return kept.unionByName(rest.select(*docs.columns))


def classes_without_ids(digest: DataFrame) -> DataFrame:
    """``(fp, class)`` of the classes in which no row has an id."""
    nodes = digest.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(links(materialize(nodes.select("fp"), "simhash-nodes")))
    labelled = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    anon = labelled.groupBy("comp").agg(F.min("low").alias("low")).filter("low is null").select("comp")
    return labelled.join(anon, "comp").select("fp", F.col("comp").alias("class"))
