"""Language detection, re-aimed as a character n-gram naive Bayes.

Training counts the n-grams of a labelled table per language, in numpy inside each
batch of texts, and Spark adds the batches up. Scoring looks the n-grams of each text up
in the profile table, in numpy too if the table is measured to be small; else the
n-grams become rows that are joined to it. Both sum per (text, language). Log-probabilities are scaled to integers, so the
sums are exact and the chosen language does not depend on summation order.

With add-one smoothing, ``log P(g|L) = log(c+1) - log(N_L + V)``; a text's
score for L is ``log prior(L) + n * (-log(N_L + V)) + sum log(c_g,L + 1)``
over its n-grams seen in L. Languages with no n-gram in common with the text
are not candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.operators.util import cut_lineage, fits_broadcast, join_on_hot_key

NGRAM = 3
SCALE = 1_000_000
MIN_LENGTH = 20
#: bits of a code point, longest n-gram that is packed into 64 bits, and code points that numpy works on at a time
CP_BITS, PACKED_NGRAM, BLOCK = 21, 3, 1 << 18


def char_ngrams(text: Column, n: int = NGRAM) -> Column:
    """Lowered character n-grams of the whole text, with repeats."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # One native regex pass: a capturing lookahead yields every overlapping
    # n-gram of code points (substring() per position would be O(n^2) on UTF-8).
    # The match takes the first one, as an empty match would go on inside a surrogate pair.
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _packer(n: int):
    """``packed`` and ``unpacked`` for n-grams; made here, so that they travel to the workers with the task."""
    def block(some: list[str], first: int):
        cps = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(first, first + len(some)), [len(t) for t in some])
        for a in range(0, max(len(cps) - n + 1, 0), BLOCK):
            b = min(a + BLOCK, len(cps) - n + 1)
            key = np.zeros(b - a, np.int64)
            for k in range(n):
                key = key << CP_BITS | cps[a + k:b + k]
            inside = row[a:b] == row[a + n - 1:b + n - 1]
            yield key[inside], row[a:b][inside]

    def packed(texts: list[str]):
        """The n-grams of ``texts`` as integers, and the number of the text of each, in blocks of about ``BLOCK``."""
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK or i == len(texts) - 1:
                yield from block(texts[start:i + 1], start)
                start, size = i + 1, 0

    def unpacked(keys: np.ndarray) -> list[str]:
        cps = np.stack([keys >> CP_BITS * (n - 1 - k) & (1 << CP_BITS) - 1 for k in range(n)], axis=1).astype("<u4")
        s = cps.tobytes().decode("utf-32-le")
        return [s[i:i + n] for i in range(0, len(s), n)]

    return packed, unpacked


def _gram_counts(docs: DataFrame, n: int) -> DataFrame:
    """(lang, gram, c) of the rows of ``lang`` and lowered ``text``."""
    packed, unpacked = _packer(n)

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = np.array(batch.column("text").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                parts = [np.unique(k, return_counts=True) for k, _ in packed(list(texts[langs == lang]))]
                if not parts:
                    continue
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.zeros(len(keys), np.int64)
                np.add.at(c, at, np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(unpacked(keys), pa.string()), "c": pa.array(c, pa.int64())})

    return docs.mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _looked_up(src: DataFrame, prof: DataFrame, n_langs: int, n: int) -> DataFrame:
    """Per row of ``_id`` and lowered ``text``: ``ng`` n-grams and, per language, the sum ``s<i>`` and number ``c<i>`` of those in the profile.

    ``prof`` is measured to be small, so every task gets it whole.
    """
    table = prof.toArrow()
    grams = table.column("gram").to_pylist()
    keys = np.array([sum(ord(ch) << CP_BITS * (n - 1 - k) for k, ch in enumerate(g)) for g in grams], np.int64)
    deltas = np.array([[np.nan if x is None else x for x in d] for d in table.column("d").to_pylist()], np.float64).reshape(len(grams), n_langs)
    order = np.argsort(keys)
    packed, _ = _packer(n)
    # one more row, of nothing, for n-grams that are not in the profile
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    seen = np.vstack([~np.isnan(deltas[order]), np.zeros((1, n_langs), bool)]).astype(np.int64)
    value = np.vstack([np.nan_to_num(deltas[order]), np.zeros((1, n_langs))]).astype(np.int64)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s, c, ng = np.zeros((len(texts), n_langs), np.int64), np.zeros((len(texts), n_langs), np.int64), np.zeros(len(texts), np.int64)
            for key, row in packed(texts):
                if not len(key):
                    continue
                at = np.searchsorted(keys, key)
                at[keys[at] != key] = len(keys) - 1
                first = np.flatnonzero(np.diff(row, prepend=-1))  # where the n-grams of a text begin
                ng[row[first]] += np.diff(np.append(first, len(row)))
                for i in range(n_langs):
                    s[row[first], i] += np.add.reduceat(value[at, i], first)
                    c[row[first], i] += np.add.reduceat(seen[at, i], first)
            sums = {f"s{i}": pa.array(s[:, i]) for i in range(n_langs)} | {f"c{i}": pa.array(c[:, i]) for i in range(n_langs)}
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "ng": pa.array(ng)} | sums)

    longs = ["ng", *[f"s{i}" for i in range(n_langs)], *[f"c{i}" for i in range(n_langs)]]
    return src.mapInArrow(run, T.StructType([src.schema["_id"], *[T.StructField(x, T.LongType()) for x in longs]]))


@dataclass
class LanguageModel:
    grams: DataFrame   # (lang, gram, delta): scaled log(count + 1)
    langs: DataFrame   # (lang, base, prior): scaled -log(N_L + V) and log prior
    _wide: tuple | None = None

    def wide(self):
        """(language constants, profile with one row per gram and an array of deltas, null where unseen)."""
        if self._wide is None:
            # one row per language of the labelled table; a profile row holds a number for each
            consts = sorted((r["lang"], r["base"], r["prior"]) for r in self.langs.collect())
            names = [c[0] for c in consts]
            g = self.grams.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "delta"))).alias("m"))
            prof = g.select("gram", F.array(*[F.col("m")[x] for x in names]).alias("d"))
            self._wide = (consts, cut_lineage(prof, up=None))
        return self._wide


def train_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                         n: int = NGRAM) -> LanguageModel:
    docs = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if n <= PACKED_NGRAM:
        counts = cut_lineage(_gram_counts(docs.select("lang", _lowered(F.col("text")).alias("text")), n))
    else:
        counts = cut_lineage(docs.select("lang", F.explode(char_ngrams(F.col("text"), n)).alias("gram"))
                             .groupBy("lang", "gram").agg(F.count("*").alias("c")))
    vocab = counts.select("gram").distinct().count()
    per_lang = docs.groupBy("lang").agg(F.count("*").alias("docs")).join(counts.groupBy("lang").agg(F.sum("c").alias("total")), "lang", "left")
    per_lang = per_lang.withColumn("total", F.coalesce("total", F.lit(0)))
    all_docs = F.sum("docs").over(Window.partitionBy())  # one row per language
    langs = per_lang.select(
        "lang",
        F.round(-F.log(F.col("total") + F.lit(vocab)) * SCALE).cast("long").alias("base"),
        F.round(F.log(F.col("docs") / all_docs) * SCALE).cast("long").alias("prior"))
    grams = counts.select("lang", "gram", F.round(F.log(F.col("c") + 1) * SCALE).cast("long").alias("delta"))
    # a trained model is data: materialise it once (reliable checkpoint), so that
    # its size check and every scoring job reuse it instead of retraining
    return LanguageModel(cut_lineage(grams, up=None), cut_lineage(langs, up=None))


def detect_language(df: DataFrame, model: LanguageModel, text: Column, id_col: str = "id",
                    n: int = NGRAM) -> DataFrame:
    """(id, detected_lang) for every input row; null when no language shares an n-gram."""
    consts, prof = model.wide()
    small = fits_broadcast(prof)
    if small and n <= PACKED_NGRAM and consts:
        found = _looked_up(df.select(F.col(id_col).alias("_id"), _lowered(text).alias("text")), prof, len(consts), n)
        per = found.groupBy("_id").agg(F.max("ng").alias("ng"), *[F.sum(f"{x}{i}").alias(f"{x}{i}") for i in range(len(consts)) for x in "sc"])
    else:
        per = _joined(df.select(F.col(id_col).alias("_id"), char_ngrams(text, n).alias("g")), prof, small, len(consts))
    cands = [F.when(F.col(f"c{i}") > 0, F.struct(
        (F.lit(prior).cast("long") + F.col("ng").cast("long") * F.lit(base).cast("long") + F.col(f"s{i}"))
        .alias("score"), F.lit(lang).alias("lang")))
        for i, (lang, base, prior) in enumerate(consts)]
    best = F.greatest(*cands) if len(cands) > 1 else (cands[0] if cands else F.lit(None))
    return per.select(F.col("_id").alias(id_col), best["lang"].alias("detected_lang") if cands
                      else F.lit(None).cast("string").alias("detected_lang"))


def _joined(src: DataFrame, prof: DataFrame, small: bool, n_langs: int) -> DataFrame:
    """The sums of ``_looked_up`` for rows of ``_id`` and the n-grams ``g``, by a join with the profile."""
    # counted per text and n-gram before the join, which takes no shuffle if the profile is broadcast:
    # the partial counts of a text meet only in the sums of its score
    ex = src.select("_id", F.size("g").alias("ng"), F.explode_outer("g").alias("gram"))
    if not small:
        ex = ex.groupBy("_id", "ng", "gram").agg(F.count(F.lit(1)).alias("k"))
    j = join_on_hot_key(ex if not small else ex.withColumn("k", F.lit(1).cast("long")), prof, "gram", "left")
    aggs = [F.max("ng").alias("ng")]
    for i in range(n_langs):
        aggs += [F.sum(F.col("d")[i] * F.col("k")).alias(f"s{i}"), F.count(F.col("d")[i]).alias(f"c{i}")]
    return j.groupBy("_id").agg(*aggs)


def is_target_language(detected: Column, text: Column, target: str, min_length: int = MIN_LENGTH) -> Column:
    """True when the text has at least ``min_length`` characters and is detected as ``target``."""
    return (F.coalesce(F.length(text), F.lit(0)) >= min_length) & F.coalesce(detected == target, F.lit(False))
