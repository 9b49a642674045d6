"""Packing: every id once, limits kept, no padding for documents, ids as the tokenizer gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from narrascope.llm import packing as P

LIMITS = P.Limits(64, 5, 64)


TOKENIZER = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


def reference(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check_cover(rows, texts, limits):
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        per_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per_doc) == set(texts)
    for key, pieces in per_doc.items():
        ids = np.array(reference(texts[key]), dtype="<u4")
        at = 0
        for start, n, crc, total in sorted(pieces):
            assert start == at and n > 0 and total == len(ids) and crc == zlib.crc32(ids[start:start + n].tobytes())
            at += n
        assert at == len(ids)
    padded = 0
    for pieces in per_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= limits.tokens and len(pieces) <= limits.segments
        padded += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padded, len(per_seq)


def test_ids_equal_the_tokenizers():
    rng = random.Random(3)
    pool = ["Hello", "it's", "they'LL", "don't", "'s", "''s", "a1b22", "x_y", "_", "--", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "<", "|>", "Ωμέγας", "ΣΑΣ", "İI",
            "e\u0301", "\u0301", "日本語", "½", "٣", "\x00", "a\x1cb", "\x7f", "\u00a0", "a\u2003b", "\u0085", "😀", "naïve,", "x" * 300, "!?.,;", "\u200b", "ﬁ"]
    words = P.Words(public_tokenizers.path(P.TOKENIZER))
    for _ in range(1500):
        text = "".join(rng.choice(pool) + rng.choice(["", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 9)))
        assert words.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["alpha", "Beta", "gamma-7", "Ünder", "tokenization"], k=rng.choice([0, 1, 2, 5, 40, 300]))) for i in range(150)}
    texts |= {900: None, 901: "", 902: "one two three four " * 2000, 903: "y" * 20_000, -5: "minus"}
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in texts.items()], "doc_id long, text string, length int, ids string")
    for parts in (1, 3, 70):
        rows = P.pack_documents(df.repartition(parts), LIMITS).collect()
        padded, n = check_cover(rows, texts, LIMITS)
        assert padded == 0
    whole = P.op13_packing(df).collect()
    assert check_cover(whole, texts, P.Limits())[0] == 0
    assert whole[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_repeats_and_empty(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(1, "same text")] * 5 + [(None, "no id"), (None, None)], "doc_id long, text string")
    rows = P.op13_packing(df).collect()
    assert sum(r["length"] for r in rows) == 5 * len(reference("same text")) + len(reference("no id")) + 1
    assert P.op13_packing(df.limit(0)).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_instruction_examples_under_three_limits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        n = rng.choice([1, 2, 3, 8, 20, 50, 70])
        rows.append((i, list(range(n)), [j >= n * rng.random() for j in range(n)]))
    rows += [(1000, None, None), (1001, [], [])]
    limits = P.Limits(64, 4, 32)
    df = spark.createDataFrame(rows, "example_id long, ids array<int>, bears_loss array<boolean>").repartition(3)
    got = P.pack_examples(df, limits).collect()
    want = {i: (len(a or []), sum(b or [])) for i, a, b in rows}
    assert len(got) == len(rows) and {r["example_id"]: (r["tokens"], r["loss"]) for r in got} == want
    seqs = defaultdict(list)
    for r in got:
        alone = r["tokens"] == 0 or r["tokens"] > 64 or r["loss"] > 32
        assert (r["sequence_id"] is None) == alone
        if not alone:
            seqs[r["sequence_id"]].append(r)
    for s in seqs.values():
        assert sum(r["tokens"] for r in s) <= 64 and len(s) <= 4 and sum(r["loss"] for r in s) <= 32
        assert [r["offset"] for r in sorted(s, key=lambda r: r["offset"])][0] == 0
    tokens, loss, n = (sum(f(r) for s in seqs.values() for r in s) for f in (lambda r: r["tokens"], lambda r: r["loss"], lambda r: 1))
    assert len(seqs) <= 1.25 * max(tokens / 64, loss / 32, n / 4) + 3


def test_largest_dot_product_goes_first():
    p = P.Packer(P.Limits(10, 3, 4), cut=False)
    for key, n, loss in (("wide", 6, 0), ("lossy", 4, 4), ("small", 2, 1)):
        assert not list(p.add(P.Example(key, 0, np.zeros(n, "<u4"), n, np.arange(n) < loss)))
    out = list(p.finish()) + [p.rest()]
    assert [[e.key for e in s] for s in out] == [["lossy", "wide"], ["small"]]
