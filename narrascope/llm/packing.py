"""Vector bin packing of tokenized examples into training sequences.

An example asks for three things at once: tokens, one segment, and loss-bearing tokens. A sequence
offers at most ``Limits`` of each. Every task keeps a pool of at most ``POOL`` waiting examples and fills
one sequence at a time: of the examples that fit, the one whose demand vector has the largest dot
product with what the sequence has left (both as shares of the limits) goes in. If none fits and examples may be
cut, the best one by the same product is cut to fill the rest, and its remainder waits on.

A task ends with one sequence that is not full. Its pieces (fewer tokens than one sequence) go on, with
their ids, to a round with 1/64 of the tasks, until one task is left. There the last sequence is cut
into lengths that are powers of two, which need no padding. So nothing is shuffled but the tails,
a task holds the pool and one Arrow batch, and the padding does not grow with the number of tasks.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_bounds, materialize

#: the vocabulary file of the registered query, as its library names it
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
POOL = 512
FAN_IN = 64
#: words that a worker keeps the ids of; a full cache starts again
CACHE = 1_000_000
#: a long text is split a slice at a time; a slice ends with a whole word
_SLICE = re.compile(rb"(?s).{1,1048576}[^\x20\x09-\x0d]*")
#: ASCII and Latin-1 letters: already in normal form, with one lower case each
_PLAIN = re.compile("[ \t-\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: the tokenizer's split pattern, for lower-case text of that kind; its branches start with different characters
_WORDS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-z\u00df-\u00f6\u00f8-\u00ff]+", re.ASCII)


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


class Words(dict):
    """Token ids of texts, through the tokenizer's own model; the dictionary holds the ids of words met.

    White space separates words under every rule of this tokenizer (its normaliser and its splitter never
    look across it), so a text's ids are those of its white-space separated parts in order. Plain text is
    lower-cased and split by the tokenizer's pattern here; parts with other characters, or with what may be a special
    token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            if _PLAIN.fullmatch(p) and "<|" not in p:
                return self.plain(p)
            got = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
            if len(p) <= 64:
                if len(self.parts) >= CACHE // 4:
                    self.parts.clear()
                self.parts[p] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        out = []
        for piece in _SLICE.finditer((text or "").encode()):
            s = piece[0].decode()
            if _PLAIN.fullmatch(s) and "<|" not in s:
                out.append(self.plain(s))
            else:
                out.extend([self.part(p.decode()) for p in piece[0].split()])
        return np.frombuffer(b"".join(out), dtype="<u4")


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


def tokenizer_path(name: str) -> str:
    """``name`` as a path of its own, or the place of that file in the installed vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Example:
    """Ids ``start`` .. of one document; ``bears`` marks the ids that bear loss (None: all)."""

    key: object
    start: int
    ids: np.ndarray
    total: int
    bears: np.ndarray | None = None

    def loss(self) -> int:
        return len(self.ids) if self.bears is None else int(self.bears.sum())

    def split(self, n: int) -> tuple[Example, Example]:
        b = self.bears
        return (Example(self.key, self.start, self.ids[:n], self.total, None if b is None else b[:n]),
                Example(self.key, self.start + n, self.ids[n:], self.total, None if b is None else b[n:]))


class Packer:
    """One task's open sequence and pool of waiting examples."""

    def __init__(self, limits: Limits, cut: bool, pool: int = POOL):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.waiting: list[Example] = []
        self.demand = np.zeros((pool, 3))
        self.open: list[Example] = []
        self.left = self.most.copy()

    def add(self, e: Example) -> Iterator[list[Example] | Example]:
        """Takes an example in; yields the sequences that became full, and examples that fit into none."""
        if self.cut:
            while len(e.ids) >= self.limits.tokens and e.bears is None and self.limits.loss >= self.limits.tokens:
                head, e = e.split(self.limits.tokens)
                yield [head]
        elif len(e.ids) > self.limits.tokens or e.loss() > self.limits.loss:
            yield e
            return
        if not len(e.ids):
            return
        self._wait(e)
        while len(self.waiting) >= self.pool:
            yield from self.place()

    def finish(self) -> Iterator[list[Example]]:
        while self.waiting:
            yield from self.place()

    def rest(self) -> list[Example]:
        """The pieces of the open sequence, which is then empty."""
        out, self.open, self.left = self.open, [], self.most.copy()
        return out

    def _wait(self, e: Example) -> None:
        self.demand[len(self.waiting)] = (len(e.ids), 1, e.loss())
        self.waiting.append(e)

    def _take(self, i: int) -> Example:
        e, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i] = self.waiting[last]
        self.demand[i] = self.demand[last]
        self.waiting.pop()
        return e

    def _put(self, e: Example) -> None:
        self.open.append(e)
        self.left -= (len(e.ids), 1, e.loss())

    def place(self) -> Iterator[list[Example]]:
        """One more piece into the open sequence, or the sequence out."""
        d = self.demand[:len(self.waiting)]
        score = (d / self.most) @ (self.left / self.most)
        fits = (d <= self.left).all(axis=1)
        if fits.any():
            self._put(self._take(int(np.where(fits, score, -1.0).argmax())))
        elif self.cut and self.left[0] >= 1 and self.left[1] >= 1 and self.left[2] >= 1:
            e = self._take(int(score.argmax()))
            n = min(len(e.ids), int(self.left[0]))
            if e.bears is not None:
                n = min(n, int(np.searchsorted(np.cumsum(e.bears), self.left[2], side="right")))
            elif n > self.left[2]:
                n = int(self.left[2])
            head, tail = e.split(n)
            if n:
                self._put(head)
            if len(tail.ids):
                self._wait(tail)
        else:
            yield from self.closed(self.rest())
            return
        if self.left[0] == 0:
            yield self.rest()

    def closed(self, pieces: list[Example]) -> Iterator[list[Example]]:
        """A sequence that ends short of its tokens: cut to powers of two if examples may be cut."""
        if not self.cut or sum(len(p.ids) for p in pieces) == self.limits.tokens:
            yield pieces
            return
        todo, n = pieces[::-1], sum(len(p.ids) for p in pieces)
        while n:
            size = 1 << (n.bit_length() - 1)
            n -= size
            out = []
            while size:
                e = todo.pop()
                if len(e.ids) > size:
                    e, more = e.split(size)
                    todo.append(more)
                out.append(e)
                size -= len(e.ids)
            yield out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tail boolean, ids binary"
_KIND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tail", pa.bool_()), ("ids", pa.binary())])


def _rows(pieces: list[Example], sequence: int, tail: bool = False) -> Iterator[tuple]:
    at = 0
    for e in pieces:
        data = e.ids.tobytes()
        yield (e.key, e.start, len(e.ids), zlib.crc32(data), e.total, sequence, None if tail else at, tail, data if tail else None)
        at += len(e.ids)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _KIND)], schema=_KIND)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _KIND)], schema=_KIND)


def _packed(examples: Iterator[Example], limits: Limits, level: int, last: bool) -> Iterator[tuple]:
    """Rows of all pieces; sequence ids are unique by round, task and number, tails carry the task."""
    packer, task = Packer(limits, cut=True), TaskContext.get().partitionId()
    number = (level << 58) | (task << 34)

    def sequences() -> Iterator[list[Example]]:
        for e in examples:
            yield from packer.add(e)
        yield from packer.finish()
        if last:
            yield from packer.closed(packer.rest())

    for pieces in sequences():
        yield from _rows(pieces, number)
        number += 1
    yield from _rows(packer.rest(), task, tail=True)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of every row.

    A row's ids are those of its text and ``end_id``; all of them bear loss. Null and empty texts have the end
    alone. Repeated rows and rows without id are packed each. Long texts fill whole sequences and leave
    a remainder. A table without rows gives no rows; columns besides ``doc_id`` and ``text`` are not read. Equal
    products go to the example that waits at the smaller place. Sequence ids are unique, not gapless.
    """
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = words_of(tokenizer_path(tokenizer)), np.array([end_id], dtype="<u4")

        def examples() -> Iterator[Example]:
            for b in batches:
                for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    ids = np.concatenate((words.ids(text.as_py()), end))
                    yield Example(key, 0, ids, len(ids))

        yield from _batches(_packed(examples(), limits, 0, last=False))

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def examples() -> Iterator[Example]:
                for b in batches:
                    for r in b.to_pylist():
                        yield Example(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])

            yield from _batches(_packed(examples(), limits, level, last))
        return run

    with arrow_bounds(spark):
        rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                           .mapInArrow(first, PIECES), "packed")
        out, level = rows.filter(~F.col("tail")), 0
        tasks = rows.filter("tail").agg(F.count_distinct("sequence_id").alias("n")).first()["n"]
        while tasks:
            last, tasks, level = tasks <= FAN_IN, math.ceil(tasks / FAN_IN), level + 1
            rows = materialize(rows.filter("tail").coalesce(tasks).mapInArrow(again(level, last), PIECES), "packed-tails")
            out = out.unionByName(rows.filter(~F.col("tail")))
            if last:
                break
    return out.drop("tail", "ids")


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Instruction data, whole examples only: ``example_id, sequence_id, offset, tokens, loss`` of every row.

    ``examples``: ``example_id``, ``ids`` (array of int) and ``bears_loss`` (array of boolean of the same length).
    Null arrays count as empty; an empty example takes no place (null sequence), and so does one that is over a
    limit by itself. Each task packs its own rows and leaves at most one sequence unfinished.
    """
    kind = pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64()), ("loss", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, cut=False), TaskContext.get().partitionId() << 34

        def placed() -> Iterator[list[Example] | Example]:
            for b in batches:
                for r in b.to_pylist():
                    ids = np.array(r["ids"] or [], dtype="<u4")
                    e = Example(r["example_id"], 0, ids, len(ids), np.array(r["bears_loss"] or [], dtype=bool))
                    if len(ids):
                        yield from packer.add(e)
                    else:
                        yield e
            yield from packer.finish()
            if packer.open:
                yield packer.rest()

        for got in placed():
            rows, at = [], 0
            for e in [got] if isinstance(got, Example) else got:
                alone = isinstance(got, Example)
                rows.append({"example_id": e.key, "sequence_id": None if alone else number, "offset": None if alone else at, "tokens": len(e.ids), "loss": e.loss()})
                at += len(e.ids)
            number += 1
            yield pa.RecordBatch.from_pylist(rows, kind)

    with arrow_bounds(examples.sparkSession):
        picked = examples.select(F.col("example_id").cast("long").alias("example_id"), F.col("ids").cast("array<int>").alias("ids"),
                                 F.col("bears_loss").cast("array<boolean>").alias("bears_loss"))
        return materialize(picked.mapInArrow(run, "example_id long, sequence_id long, offset long, tokens long, loss long"), "packed-examples")


def op13_packing(docs: DataFrame) -> DataFrame:
    """All documents in sequences of 4096 tokens; see ``pack_documents`` for nulls, ties, repeats and empty tables."""
    return pack_documents(docs)
