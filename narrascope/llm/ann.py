"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Every unit vector is rotated by one random orthogonal matrix (per dimension, seeded) and kept as the
signs of its coordinates, packed, plus a correction scalar: its inner product with the sign vector.
For a query, rotated likewise and quantised to four bits, popcounts of the packed bits against the
query's bit planes give an unbiased estimate of the cosine, with an error bound that holds with high
probability. In a block of vectors, the k-th largest lower bound is a threshold; only vectors whose
upper bound reaches it are reranked with their original components in double precision.

Equal vectors are one class (their smallest ids are kept), so a vector with a third of all rows is
searched once. Queries and vectors are dealt into blocks of bounded size by hash; every query block
meets every vector block in a task of its own and returns its k best, so memory is bounded by two
blocks and what is shuffled per query by k rows a block. Every row is indexed; nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_function, bound_arrow, materialize

K = 5
BLOCK_ROWS = 8192
EPSILON = 3.0
QUERY_BITS = 4
ID_SALT = 64
SEED = 11


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words) and correction scalars of unit vectors."""
    dim = vectors.shape[1]
    turned = vectors @ rotation(dim)
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    wide = np.zeros((len(bits), -(-dim // 64) * 8), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view(np.uint64), np.abs(turned).sum(axis=1) / np.sqrt(dim)


@arrow_function("struct<code:binary,scale:double>")
def codes(vectors: pa.Array) -> pa.Array:
    rows = vectors.to_pylist()
    code, scale = [b""] * len(rows), np.zeros(len(rows))
    dims = np.array([len(r) for r in rows])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        v = np.array([rows[i] for i in at], dtype=np.float64)
        packed, f = encode(v / np.linalg.norm(v, axis=1, keepdims=True))
        scale[at] = f
        for i, p in zip(at, packed):
            code[i] = p.tobytes()
    return pa.StructArray.from_arrays([pa.array(code, pa.binary()), pa.array(scale)], ["code", "scale"])


def estimate(query: np.ndarray, code: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of one rotated unit query against packed codes, and their error bounds."""
    dim = len(query)
    low, top = query.min(), query.max()
    delta = max((top - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    level = np.rint((query - low) / delta).astype(np.uint8)
    hits = np.zeros(len(code), dtype=np.int64)
    for b in range(QUERY_BITS):
        plane = np.zeros(code.shape[1] * 8, dtype=np.uint8)
        bits = np.packbits((level >> b) & 1, bitorder="little")
        plane[: len(bits)] = bits
        hits += np.bitwise_count(code & plane.view(np.uint64)).sum(axis=1, dtype=np.int64) << b
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    inner = (2 * (low * ones + delta * hits) - (low * dim + delta * level.sum(dtype=np.int64))) / np.sqrt(dim)
    spread = np.sqrt(np.maximum(1 - scale**2, 0)) / (scale * np.sqrt(max(dim - 1, 1)))
    return inner / scale, EPSILON * (spread + delta / (np.sqrt(3) * scale))


def search_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best vectors of a block for each query, never its own class; exact scores."""
    q_ids, v_ids = queries["cid"].to_numpy(), block["cid"].to_numpy()
    q = np.stack(queries["vec"].to_numpy()).astype(np.float64)
    v = np.stack(block["vec"].to_numpy()).astype(np.float64)
    v_norm = np.sqrt((v * v).sum(axis=1))
    code = np.stack([np.frombuffer(c, dtype=np.uint64) for c in block["code"]])
    scale = block["scale"].to_numpy()
    turn = rotation(q.shape[1])
    out = []
    for i, x in enumerate(q):
        norm = np.sqrt((x * x).sum())
        est, err = estimate(x / norm @ turn, code, scale)
        other = v_ids != q_ids[i]
        lower = np.where(other, est - err, -np.inf)
        bar = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
        at = np.flatnonzero(other & (est + err >= bar))
        score = (v[at] * x).sum(axis=1) / (v_norm[at] * norm)
        best = np.lexsort((v_ids[at], -score))[:k]
        out.append(pd.DataFrame({"query": q_ids[i], "cid": v_ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "cid": [], "score": []})


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """``vec`` and the ``n`` smallest ids that hold it, ascending; a hot vector is reduced in salted parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(ID_SALT))).withColumn("key", F.xxhash64("vec"))
    part = Window.partitionBy("key", "salt", "vec").orderBy("id")
    whole = Window.partitionBy("key", "vec").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= n)
    few = few.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= n)
    return few.groupBy("key", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).drop("key")


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row for which ``queries`` holds.

    Null, zero and non-finite vectors and null ids take no part, nor do vectors of another length than the
    query's. Repeated rows (equal id and vector) count once. Ties go to the smaller id. Columns of
    ``vectors`` other than the two named are not looked at.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    rows = (vectors.filter(valid(F.col(vec_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"),
                    F.coalesce(queries, F.lit(False)).alias("asks")).distinct())
    rows = materialize(rows.withColumn("key", F.xxhash64("vec")), "ann-rows")
    held = smallest_ids(rows.select("id", "vec"), k + 1).withColumn("cid", F.col("ids")[0])
    held = materialize(held.withColumn("c", codes("vec")).select("cid", "ids", "vec", F.size("vec").alias("dim"), "c.code", "c.scale"),
                       "ann-codes")
    asks = rows.filter("asks").select("id", "vec", "key")
    asks = asks.join(held.select("vec", F.xxhash64("vec").alias("key"), "cid", "dim"), ["key", "vec"])
    asks = materialize(asks.select(F.col("id").alias("query_id"), "cid", "dim", "vec"), "ann-queries")
    classes = asks.groupBy("cid").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    blocks = lambda n: max(1, -(-n // block_rows))
    n_v, n_q = blocks(held.count()), blocks(asks.count())
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.select("cid", "vec", "dim", deal(n_q).cast("int").alias("qb"), every(n_v).alias("vb"))
    right = held.select("cid", "vec", "code", "scale", "dim", deal(n_v).cast("int").alias("vb"), every(n_q).alias("qb"))
    empty = pd.DataFrame({"query": [], "cid": [], "score": []})
    met = (left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb"))
           .applyInPandas(lambda a, b: search_block(a, b, k) if len(a) and len(b) else empty, "query long, cid long, score double"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    top = met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")
    ids = held.select("cid", "ids")
    others = top.join(ids, "cid").select("query", "score", "ids")
    own = classes.join(held.select("cid", "ids", F.col("vec").alias("v")), "cid").select(F.col("cid").alias("query"), own_score("v").alias("score"), "ids")
    lists = others.unionByName(own).select("query", "score", F.explode("ids").alias("vec_id"))
    found = (asks.select("query_id", F.col("cid").alias("query")).join(lists, "query").filter("vec_id <> query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@arrow_function("double")
def own_score(vectors: pa.Array) -> pa.Array:
    """A vector's cosine with itself, computed like every other score."""
    out = []
    for row in vectors.to_pylist():
        v = np.array(row, dtype=np.float64)
        out.append(float((v * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((v * v).sum()))))
    return pa.array(out, pa.float64())


def op2_rabit(vectors: DataFrame) -> DataFrame:
    """The 5 nearest rows of every row whose ``vec_id`` is divisible by 50."""
    return nearest(vectors, F.col("vec_id") % 50 == 0)
