"""Repair of a conversation's structure: the cheapest edits to ``(s?(ua)+)?``, by bidirectional Dijkstra.

The edit lattice of a conversation has a node for each (rows consumed, state of the role pattern). Keep,
Rerole and Delete consume a row, Insert does not. A forward heap starts at (0, start), a reverse
heap at the accepting ends; once they meet, both go on until no crossing of equal cost is left, and the
least concatenated audit is read off the crossings.

A conversation may be any length, so it is cut into segments of at most ``2**SEGMENT_BITS`` rows that are
contiguous in a global order (range partitions, sorted). A conversation in one segment is solved there.
Else each segment gives the best (cost, audit) from every state to every state, and those are
composed ``2**FAN_BITS`` at a time in rounds. That is exact: two audits of equal cost over the same rows
and states are never a prefix of each other (the longer one would end in Inserts, which cost), so
the least of each part makes the least whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_bounds, arrow_function, materialize

SPACE = " \t\n\x0b\x0c\r"
SEGMENT_BITS = 12
FAN_BITS = 5
INITIALS, FAULTS = "sua-", ("", "blank", "duplicate", "truncated")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: states of the pattern: nothing yet, after s, after u, after a; a sequence may end in START or AFTER_A
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
#: the states from which a role initial is legal, and the state it leads to
STEP = {"s": ((START,), AFTER_S), "u": ((START, AFTER_S, AFTER_A), AFTER_U), "a": ((AFTER_U,), AFTER_A)}
FAR = 1 << 60


def code_of(initial: int, fault: int) -> str:
    return chr(65 + 4 * initial + fault)


class Lattice:
    """Arcs of the edit lattice over ``codes``, one letter a row (initial and fault); node = 4 * row + state."""

    def __init__(self, codes: str):
        self.n = len(codes)
        self.after: list[dict[int, list[tuple[int, int, str]]]] = []  # by row: state -> (next state, cost, letter)
        self.before: list[dict[int, list[tuple[int, int, str]]]] = []
        for c in codes:
            out, back = _row_arcs(c)
            self.after.append(out)
            self.before.append(back)

    def forward(self, node: int) -> Iterator[tuple[int, int, str]]:
        i, s = divmod(node, 4)
        if i < self.n:
            for t, cost, letter in self.after[i][s]:
                yield node - s + 4 + t, cost, letter
        yield node - s + (AFTER_A if s == AFTER_U else AFTER_U), INSERT, "I"

    def reverse(self, node: int) -> Iterator[tuple[int, int, str]]:
        i, s = divmod(node, 4)
        if i:
            for t, cost, letter in self.before[i - 1][s]:
                yield node - s - 4 + t, cost, letter
        if s == AFTER_A:
            yield node - s + AFTER_U, INSERT, "I"
        elif s == AFTER_U:
            for t in STEP["u"][0]:
                yield node - s + t, INSERT, "I"


@functools.cache
def _row_arcs(code: str) -> tuple[dict, dict]:
    initial, fault = divmod(ord(code) - 65, 4)
    initial, fault = INITIALS[initial], FAULTS[fault]
    out = {s: [(s, DELETE, "D")] for s in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for role, (olds, new) in STEP.items():
            for s in olds:
                if role == initial:
                    out[s].append((new, more, "K"))
                if role != "s":
                    out[s].append((new, REROLE + more, "R"))
    back = {s: [] for s in range(4)}
    for s, arcs in out.items():
        for t, cost, letter in arcs:
            back[t].append((s, cost, letter))
    return out, back


def cheapest(codes: str, start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost and, of the edits with that cost, the ASCII-least audit; None if no edits lead there."""
    g = Lattice(codes)
    size, last = 4 * (g.n + 1), 4 * g.n
    dist = [[FAR] * size, [FAR] * size]
    done = [bytearray(size), bytearray(size)]
    heaps: list[list[tuple[int, int, int]]] = [[(0, start, start)], [(0, 0, last + t) for t in ends]]
    dist[0][start] = 0
    for t in ends:
        dist[1][last + t] = 0
    order, best = [], 0 if g.n == 0 and start in ends else FAR
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        d, _, u = heapq.heappop(heaps[side])
        if done[side][u]:
            continue
        done[side][u] = 1
        if side == 0:
            order.append(u)
        near, far = dist[side], dist[1 - side]
        for v, cost, _ in (g.reverse if side else g.forward)(u):
            if d + cost < near[v]:
                near[v] = d + cost
                heapq.heappush(heaps[side], (d + cost, -v if side else v, v))
            if d + cost + far[v] < best:
                best = d + cost + far[v]
    if best >= FAR:
        return None
    ahead, behind = dist
    alive = bytearray(size)  # nodes of the forward side from which a crossing of the least cost is reached
    for u in reversed(order):
        alive[u] = (ahead[u] == best and u - last in ends) or any((done[1][v] and ahead[u] + c + behind[v] == best) or (alive[v] and ahead[u] + c == ahead[v]) for v, c, _ in g.forward(u))
    audit, at, spent = [], {start}, 0
    while not (spent == best and any(v - last in ends for v in at)):
        step: dict[str, set[int]] = {}
        costs = {}
        for u in at:
            for v, c, letter in g.forward(u):
                to = spent + c
                if (to + behind[v] == best) if done[1][v] else (alive[v] and ahead[v] == to):
                    step.setdefault(letter, set()).add(v)
                    costs[letter] = to
        letter = min(step)
        audit.append(letter)
        at, spent = step[letter], costs[letter]
    return best, "".join(audit)


@functools.lru_cache(maxsize=50_000)
def _cheapest_short(codes: str) -> tuple[int, str]:
    return cheapest(codes)


BEST = "struct<cost:long,audit:string>"
PATHS = "array<struct<s:int,t:int,cost:long,audit:string>>"
_BEST = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_PATHS = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


@arrow_function(BEST)
def solve(codes: pa.Array) -> pa.Array:
    out = [(_cheapest_short(c) if len(c) <= 64 else cheapest(c)) for c in codes.to_pylist()]
    return pa.array([{"cost": c, "audit": a} for c, a in out], _BEST)


def all_paths(codes: str) -> list[dict]:
    got = [(s, t, cheapest(codes, s, (t,))) for s in range(4) for t in range(4)]
    return [{"s": s, "t": t, "cost": b[0], "audit": b[1]} for s, t, b in got if b]


def compose(first: list[dict], second: list[dict]) -> list[dict]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a in first:
        for b in second:
            if a["t"] == b["s"]:
                key, cost = (a["s"], b["t"]), a["cost"] + b["cost"]
                old = best.get(key)
                if old is None or cost <= old[0]:
                    new = (cost, a["audit"] + b["audit"])
                    best[key] = new if old is None else min(old, new)
    return [{"s": s, "t": t, "cost": c, "audit": x} for (s, t), (c, x) in best.items()]


@arrow_function(PATHS)
def segment_paths(codes: pa.Array) -> pa.Array:
    return pa.array([all_paths(c) for c in codes.to_pylist()], _PATHS)


@arrow_function(PATHS)
def composed(groups: pa.Array) -> pa.Array:
    return pa.array([functools.reduce(compose, [x["paths"] for x in g]) for g in groups.to_pylist()], _PATHS)


def initial_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, present) in one global order: ``pos`` ascends by conversation and turn.

    Range partitions, sorted, so that a conversation of any length spreads over tasks. Rows of one turn follow
    the digest of role and text; repeated rows are adjacent.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.substring(ended, -1, 1)
    r = rows.select("conv_id", "turn", "role", "text", "present",
                    F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("tie"),
                    initial_of(F.col("role")).alias("initial"),
                    F.when(ended == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
                    F.monotonically_increasing_id().alias("uid"))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("tie"), F.asc("uid")]
    placed = r.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(placed.drop("uid").withColumn("pos", F.monotonically_increasing_id()), "conv-rows")


def segments(rows: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """``conv_id, block, first, codes``: at most ``2**bits`` rows of one conversation, contiguous in ``pos``."""
    facts = rows.filter("present").select("conv_id", "pos", "tie", "initial", "fault")
    again = (facts.groupBy("conv_id", "tie").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.col("conv_id").alias("d_conv"), F.col("tie").alias("d_tie"), "first_pos"))
    met = facts.join(again, F.col("conv_id").eqNullSafe(F.col("d_conv")) & (F.col("tie") == F.col("d_tie")), "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("pos") > F.col("first_pos"), 2).otherwise(F.col("fault"))
    coded = met.select("conv_id", "pos", F.char(65 + 4 * F.col("initial") + fault).alias("code"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return materialize(coded.groupBy("conv_id", F.shiftright("pos", bits).alias("block"))
                       .agg(F.min("pos").alias("first"), F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes")), "conv-segments")


def best_edits(segs: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` of every conversation that has rows."""
    many = materialize(segs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("m_conv")), "conv-long")
    in_many = F.col("conv_id").eqNullSafe(F.col("m_conv"))
    best = segs.join(many, in_many, "left_anti").select("conv_id", solve("codes").alias("b")).select("conv_id", "b.cost", "b.audit")
    if many.isEmpty():
        return best
    paths = materialize(segs.join(many, in_many, "left_semi").select("conv_id", "block", segment_paths("codes").alias("paths")), "conv-paths")
    while not paths.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        groups = paths.groupBy("conv_id", F.shiftright("block", FAN_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "paths"))).alias("g"))
        paths = materialize(groups.select("conv_id", "block", composed("g").alias("paths")), "conv-paths")
    whole = F.filter("paths", lambda p: (p["s"] == START) & p["t"].isin(*ENDS))
    least = F.array_min(F.transform(whole, lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    return best.unionByName(paths.select("conv_id", least.alias("b")).select("conv_id", "b.cost", "b.audit"))


DIGEST = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
_DIGEST = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPAIRED = "conv_id long, place long, edit string, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
MOST = (1 << 63) - 1


class Repair:
    """Applies one conversation's audit to its rows as they stream by, in order."""

    def __init__(self, conv, cost: int, audit: str):
        self.conv, self.cost, self.audit = conv, cost, audit
        self.at = self.place = 0
        self.odd = (len(audit) - audit.count("D")) & 1
        self.codes, self.code_at, self.last = "", 0, None
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def _role(self) -> str:
        return "assistant" if (self.place - self.odd) & 1 else "user"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", self._role(), ""
            self.place += 1
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        initial, fault = divmod(ord(self.codes[self.code_at]) - 65, 4)
        self.code_at += 1
        self.faults[fault] += 1
        pair = INITIALS[initial] if self.last is None else self.last + INITIALS[initial]
        self.illegal += len(pair) == 2 and pair not in ("su", "ua", "au")
        self.last = INITIALS[initial]
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = self.high = turn
            self.low = turn if self.low is None else self.low
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, role if edit == "K" else self._role(), text
            self.place += 1

    def digest(self, sha: str) -> dict:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.faults[1], "duplicate": self.faults[2], "truncated": self.faults[3],
                "illegal": self.illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": sha}


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Repair, tuple[str, str, str] | None]]:
    """Every conversation's repaired (edit, role, text) in order, and None at its end."""
    now: Repair | None = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "cost")]
        for conv, kind, turn, role, text, cost in zip(*cols):
            if now is None or conv != now.conv:
                if now is not None:
                    for x in now.inserts():
                        yield now, x
                    yield now, None
                now = Repair(conv, cost or 0, text if kind == 0 else "")
            if kind == 1:
                now.codes, now.code_at = text, 0
            elif kind == 2:
                for x in now.row(turn, role, text):
                    yield now, x
    if now is not None:
        for x in now.inserts():
            yield now, x
        yield now, None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, sha, first = [], hashlib.sha256(), True
    for conv, x in _walk(batches):
        if x is not None:
            sha.update((("" if first else "\n") + f"{x[1]}:{x[2]}").encode())
            first = False
            continue
        out.append(conv.digest(sha.hexdigest()))
        sha, first = hashlib.sha256(), True
        if len(out) == 2000:
            yield pa.RecordBatch.from_pylist(out, _DIGEST)
            out = []
    yield pa.RecordBatch.from_pylist(out, _DIGEST)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, place = [], 0, 0
    for conv, x in _walk(batches):
        if x is None:
            place = 0
            continue
        out.append({"conv_id": conv.conv, "place": place, "edit": x[0], "role": x[1], "text": x[2]})
        place, size = place + 1, size + len(x[2])
        if len(out) == 2000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(out, _REPAIRED)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, _REPAIRED)


def _streamed(rows: DataFrame, step, schema: str, bits: int) -> DataFrame:
    """Rows, codes and audits of each conversation sorted behind each other, through ``step`` in one task per hash part.

    A digest over a whole conversation is sequential, so its rows pass through one task, as a stream.
    """
    with arrow_bounds(rows.sparkSession):
        placed = ordered(rows)
        segs = segments(placed, bits)
        null = lambda kind: F.lit(None).cast(kind)
        parts = [best_edits(segs).select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), null("long").alias("turn"),
                                         null("string").alias("role"), F.col("audit").alias("text"), "cost"),
                 segs.select("conv_id", F.col("first").alias("pos"), F.lit(1).alias("kind"), null("long").alias("turn"), null("string").alias("role"),
                             F.col("codes").alias("text"), null("long").alias("cost")),
                 placed.select("conv_id", "pos", F.when(F.col("present"), 2).otherwise(3).alias("kind"), "turn", "role", "text", null("long").alias("cost"))]
        stream = functools.reduce(DataFrame.unionByName, parts).repartition("conv_id")
        stream = stream.sortWithinPartitions(F.asc_nulls_first("conv_id"), "pos", "kind")
        return materialize(stream.mapInArrow(step, schema), "conv-repaired")


def with_nulls_as_space(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage; dropped rows stay as rows that are not ``present``, so their conversation is known."""
    c = with_nulls_as_space(conversations)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("rule", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("rule").isin(0, 1), "").when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("rule") == 0, "").when(F.col("rule") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("rule") != 0).alias("present"), F.explode(times).alias("copy")).drop("copy")


def repair_conversations(conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows of every conversation after the cheapest edits (K, R, I).

    Nulls: a null role or text is one space (so the text is blank), null turns come first, rows without
    conversation form one. Rows of one turn follow the digest of role and text; repeated rows are duplicates and
    are deleted. Texts of any length pass whole. Conversations without rows left, and empty tables, give no rows.
    Further columns, whatever their names, are not read.
    """
    return _streamed(with_nulls_as_space(conversations).withColumn("present", F.lit(True)), _repaired, REPAIRED, segment_bits)


def diagnose_conversations(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row a conversation: its faults, the cost and audit of the cheapest edits, and the digest of what they give.

    ``rows``: conv_id, turn, role, text, present; see ``repair_conversations`` for nulls and ties. A conversation none
    of whose rows is present has zeros, an empty audit and the digest of the empty string. ``gaps`` stops at 2^63-1.
    """
    return _streamed(rows, _digests, DIGEST, segment_bits)


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    """All conversations, damaged as the contract says, and repaired; see ``diagnose_conversations``."""
    return diagnose_conversations(damaged(conversations))
