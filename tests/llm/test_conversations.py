"""Conversation repair against a plain dynamic program over the edits, and every edit list on short ones."""

import hashlib
import itertools
import random
import re
import zlib

from narrascope.llm import conversations as C

LEGAL = re.compile(r"(s?(ua)+)?")
WS = " \t\n\x0b\x0c\r"


def faults(rows):
    """(initial, fault) of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
    return out


def every_repair(facts):
    """Least (cost, audit) over all edit lists with up to two inserts between rows."""
    best = None
    choices = []
    for initial, fault in facts:
        more = fault == "truncated"
        choices.append([(3, "D", "")] + ([] if fault in ("blank", "duplicate") else [(more, "K", initial), (2 + more, "R", "u"), (2 + more, "R", "a")]))
    gaps = [(0, "", ""), (2, "I", "u"), (2, "I", "a"), (4, "II", "ua"), (4, "II", "au")]
    for picked in itertools.product(*choices):
        if best is not None and sum(p[0] for p in picked) > best[0]:
            continue
        for ins in itertools.product(gaps, repeat=len(picked) + 1):
            steps = [ins[0]] + [x for pair in zip(picked, ins[1:]) for x in pair]
            cost = sum(s[0] for s in steps)
            if best is not None and cost > best[0]:
                continue
            if LEGAL.fullmatch("".join(s[2] for s in steps)):
                got = (cost, "".join(s[1] for s in steps))
                best = got if best is None else min(best, got)
    return best


def plain(facts):
    """The same by dynamic programming from the end: least (cost, audit) from each state."""
    into = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    none = (1 << 40, "")
    add = lambda cost, letter, rest: (cost + rest[0], letter + rest[1])

    def inserts(d):
        for _ in range(2):
            d = [min(d[s], add(2, "I", d[3 if s == 2 else 2])) for s in range(4)]
        return d

    d = inserts([(0, ""), none, none, (0, "")])
    for initial, fault in reversed(facts):
        new = []
        for s in range(4):
            options, more = [add(3, "D", d[s])], fault == "truncated"
            if fault not in ("blank", "duplicate"):
                if s in into.get(initial, {}):
                    options.append(add(more, "K", d[into[initial][s]]))
                options += [add(2 + more, "R", d[into[r][s]]) for r in "ua" if s in into[r]]
            new.append(min(options))
        d = inserts(new)
    return d[0]


def codes(facts):
    return "".join(C.code_of("sua-".index(i), C.FAULTS.index(f)) for i, f in facts)


def some_facts(rng, n):
    return [(rng.choice("ssuuuaaa-"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_plain_program_equals_every_edit_list():
    rng = random.Random(1)
    for _ in range(60):
        facts = some_facts(rng, rng.randint(1, 3))
        assert plain(facts) == every_repair(facts)


def test_bidirectional_search_and_composition_equal_the_plain_program():
    rng = random.Random(2)
    for k in range(3000):
        facts = some_facts(rng, rng.randint(1, 12) if k % 50 else 200)
        assert C.cheapest(codes(facts)) == plain(facts)
    for _ in range(150):
        facts = some_facts(rng, rng.randint(2, 40))
        cuts = sorted({0, len(facts), *(rng.randrange(len(facts)) for _ in range(4))})
        paths = None
        for a, b in zip(cuts, cuts[1:]):
            part = C.all_paths(codes(facts[a:b]))
            paths = part if paths is None else C.compose(paths, part)
        assert min((p["cost"], p["audit"]) for p in paths if p["s"] == 0 and p["t"] in (0, 3)) == plain(facts)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
    return out


def expected(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        tie = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
        mine = [r[1:] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, tie(r)))]
        facts = faults(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        cost, audit = plain(facts) if mine else (0, "")
        m, kept, at = len(audit) - audit.count("D"), [], 0
        place = 0
        for x in audit:
            role = "assistant" if (place - m % 2) % 2 else "user"
            if x == "I":
                kept.append((role, ""))
            elif x != "D":
                kept.append((mine[at][1] if x == "K" else role, mine[at][2]))
            place += x != "D"
            at += x != "I"
        count = lambda f: sum(x[1] == f for x in facts)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal,
                     cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())
    return out


def conversations(rng):
    texts = ["Fine.", "What?", "no end", " ", "", "Yes!  \n", "end. ", "x" * 50_000 + ".", None]
    rows = []
    for conv in range(80):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}" + rng.choice([".", "", "?"])) for t in range(700)]
    rows += [(501, 3, "user", "the same.")] * 300 + [(502, None, "user", "Q?"), (502, None, "assistant", "A."), (502, 4, "user", "Q2?")]
    rows += [(None, 0, "user", "lost?"), (None, None, "assistant", "yes."), (-7, -(1 << 62), "user", "a."), (-7, 1 << 62, "assistant", "b.")]
    dropped = next(k for k in range(10_000, 20_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "gone.")]


def test_query_equals_the_plain_program(spark):
    rows = conversations(random.Random(4))
    want = expected(rows, damage(rows))
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, pos int, codes string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.op11_conversation_repair(df).collect()}
    assert got == want
    small = C.diagnose_conversations(C.damaged(df), segment_bits=3).collect()  # long conversations over many segments
    assert {r["conv_id"]: tuple(r)[1:] for r in small} == want


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "system", "Be nice."), (2, 1, "assistant", "Hello."), (2, 2, "assistant", "Hello.")]
    got = C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in got] == [
        (1, "K", "user", "Hi."), (1, "R", "assistant", "Again."), (2, "K", "system", "Be nice."), (2, "I", "user", ""), (2, "K", "assistant", "Hello.")]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.op11_conversation_repair(none).count() == 0 and C.repair_conversations(none).count() == 0
