"""Toxicity as multiple-instance learning: a document is toxic if some sentence is.

Each sentence that holds a learned term gets ``p = sigmoid(b + sum of its terms' weights)``; a
document's score is the noisy-or ``1 - (1 - leak) * prod(1 - p)`` over its sentences, where the leak is the
chance that a document is labelled toxic without any such sentence. Only document labels are used;
weights, bias and leak maximise their likelihood, so the sentences that explain a label are found by the
model, and ``offending_sentences`` returns them.

Terms are chosen by a Spark aggregation over all labelled training rows (document frequency by label);
every term that passes ``MIN_Z`` and ``MIN_ROWS`` is kept. The weights are fitted on at most ``MAX_FIT_ROWS`` labelled rows, chosen by hash, of which only the
sentences with a chosen term leave the executors; a term that none of them holds gets the weight that
makes its share of toxic rows, over all rows, the chance of a sentence with it. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_function, bound_arrow, materialize

#: bound on the labelled rows that the weights are fitted on
MAX_FIT_ROWS = 20_000
#: files of their features, one driver job each at most
FIT_FILES = 8
MIN_ROWS = 5
MIN_Z = 5.0
THRESHOLD = 0.7
_TERM = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


@dataclass
class Model:
    """Learned weights; an empty vocabulary scores every document with the leak."""

    leak: float = 0.0
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def sentence_terms(text: str | None, vocabulary) -> list[tuple[int, int, set[str]]]:
    """Start, end and known terms of each sentence that has any."""
    low = (text or "").lower()
    if len(low) != len(text or ""):  # a letter whose lower case is longer: keep offsets of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if vocabulary.isdisjoint(_TERM.findall(low)):
        return []
    out = []
    for a, b in sentence_spans(low):
        known = vocabulary.intersection(_TERM.findall(low, a, b))
        if known:
            out.append((a, b, known))
    return out


@arrow_function("array<string>")
def distinct_terms(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(set(_TERM.findall((t or "").lower()))) for t in texts.to_pylist()], pa.list_(pa.string()))


def choose_terms(rows: DataFrame) -> dict[str, float]:
    """All terms whose share of toxic documents is far above the mean, and that share (smoothed), from ``rows`` (text, toxic)."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = facts["n"], facts["t"] or 0
    if not 0 < t < n:
        return {}
    rate = t / n
    df = (rows.select("toxic", F.explode(distinct_terms("text")).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= MIN_ROWS))
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = df.withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term")
    return {r["term"]: (r["t"] + rate) / (r["n"] + 1) for r in best.select("term", "n", "t").collect()}


def fit_weights(labels: np.ndarray, docs: np.ndarray, sentences: np.ndarray, terms: np.ndarray, n_terms: int,
                steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[float, float, np.ndarray]:
    """Maximum-likelihood leak, bias and weights of the noisy-or by full-batch Adam.

    ``docs[s]`` is the document of sentence ``s``; ``sentences`` and ``terms`` list (sentence, term) pairs.
    """
    x = np.concatenate(([-3.0, -3.0], np.full(n_terms, 1.0)))
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = len(labels)
    for step in range(1, steps + 1):
        z = x[1] + np.bincount(sentences, weights=x[2:][terms], minlength=len(docs))
        log_q = -np.logaddexp(0, z)  # log of a sentence being clean
        leak = 1 / (1 + np.exp(-x[0]))
        log_clean = np.bincount(docs, weights=log_q, minlength=n) + np.log1p(-leak)
        p = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-12)
        # d loss / d log_clean, with loss = -y log p - (1 - y) log_clean
        g = (labels * np.exp(log_clean) / p - (1 - labels)) / n
        sent = g[docs] * -(1 / (1 + np.exp(-z)))
        grad = np.concatenate(([(g * -leak).sum()], [sent.sum()], np.bincount(terms, weights=sent[sentences], minlength=n_terms)))
        grad[2:] += l2 * x[2:] / max(n_terms, 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(1 / (1 + np.exp(-x[0]))), float(x[1]), x[2:]


def fit(rows: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on ``rows`` (doc_id, text, toxic): term statistics on all, weights on ``max_rows`` of them by hash."""
    bound_arrow(rows.sparkSession)
    terms = choose_terms(rows)
    sample = rows.withColumn("pick", F.xxhash64("doc_id"))
    n = rows.count()
    if n > max_rows:  # hash values are uniform: this range holds about max_rows of them
        sample = sample.filter(F.col("pick") < int(-(1 << 63) + (1 << 64) * (max_rows / n)))
    index = {t: i for i, t in enumerate(terms)}
    vocabulary = rows.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("array<array<int>>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = vocabulary.value
        known = frozenset(held)
        for texts in batches:
            yield pa.array([[sorted(held[w] for w in s[2]) for s in sentence_terms(t.as_py(), known)] for t in texts],
                           pa.list_(pa.list_(pa.int32())))

    # the features are written by one job into a fixed number of files, so the driver reads them by few jobs however many files the table has
    chosen = sample.select("toxic", "pick", features("text").alias("f")).repartition(FIT_FILES, "pick").sortWithinPartitions("pick")
    labels, docs, sent, term = [], [], [], []
    for d, r in enumerate(materialize(chosen, "toxicity-fit").toLocalIterator()):
        labels.append(r["toxic"])
        for s in r["f"]:
            sent.extend([len(docs)] * len(s)), term.extend(s)
            docs.append(d)
    if not labels:
        return Model()
    y = np.array(labels, dtype=np.float64)
    if not terms:
        return Model(leak=float(y.mean()))
    as_int = lambda a: np.array(a, dtype=np.int64)
    leak, bias, w = fit_weights(y, as_int(docs), as_int(sent), as_int(term), len(terms))
    share = np.array(list(terms.values()))
    unseen = np.bincount(as_int(term), minlength=len(terms)) == 0
    w = np.where(unseen, np.log(share / (1 - share)) - bias, w)
    return Model(leak, bias, dict(zip(terms, w.tolist())))


def sentence_scores(model: Model, text: str | None, known: frozenset) -> list[tuple[int, int, float]]:
    """Start, end (code points, in the text) and probability of each sentence with a known term."""
    return [(a, b, float(1 / (1 + np.exp(-(model.bias + sum(model.weights[w] for w in sorted(terms)))))))
            for a, b, terms in sentence_terms(text, known)]


def noisy_or(model: Model, scores) -> float:
    clean = 1 - model.leak
    for s in scores:
        clean *= 1 - s[2]
    return 1 - clean


SENTENCES = "array<struct<start:int,stop:int,p:double>>"


def scorer(spark: SparkSession, model: Model):
    """A UDF: a text's score and its sentences with a known term."""
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    @F.arrow_udf(f"struct<score:double,sentences:{SENTENCES}>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        known = frozenset(held.weights)
        for texts in batches:
            found = [sentence_scores(held, t.as_py(), known) for t in texts]
            scores = pa.array([noisy_or(held, f) for f in found], pa.float64())
            lists = pa.array([[{"start": a, "stop": b, "p": p} for a, b, p in f] for f in found], kind)
            yield pa.StructArray.from_arrays([scores, lists], ["score", "sentences"])

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled rows that are not held out; conflicting labels count as toxic."""
    y = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    mine = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return mine.join(y.hint("merge"), "doc_id")  # labels grow with the documents: one plan at every size


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(materialize(training_rows(docs, labels), "toxicity-train"))


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, and ``n_offending``, its sentences with p >= 0.5.

    Null and empty texts score the leak; a null ``doc_id`` is not held out (and never trains). Without labels
    the score is 0. Repeated rows are all returned, with equal scores.
    """
    score = scorer(docs.sparkSession, train(docs, labels))
    r = docs.select("doc_id", score("text").alias("s"))
    return r.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"),
                    (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"),
                    F.size(F.filter("s.sentences", lambda x: x["p"] >= 0.5)).alias("n_offending"))


def offending_sentences(docs: DataFrame, model: Model, min_p: float = 0.5) -> DataFrame:
    """One row per offending sentence: ``doc_id, start, stop, p, sentence``."""
    score = scorer(docs.sparkSession, model)
    s = docs.select("doc_id", "text", F.explode(score("text")["sentences"]).alias("x")).filter(F.col("x.p") >= min_p)
    return s.select("doc_id", "x.start", "x.stop", "x.p", F.substr("text", F.col("x.start") + 1, F.col("x.stop") - F.col("x.start")).alias("sentence"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns, no row moved."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.filter(score("text")["score"] < threshold)
