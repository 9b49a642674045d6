"""Personal data: patterns against plain regexes, disclosure against counts by hand."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from narrascope.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        n = int(c)
        if i % 2:
            n = n * 2
            n = n // 10 + n % 10
        s += n
    return s % 10 == 0


def slow(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and slow_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.+-09 ()%_\né25", max_size=60))
def test_spans_equal_plain_regexes(text):
    assert P.base_spans(text) == slow(text)


def test_long_runs_are_linear():
    for text in ("a" * 500_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "+" * 200_000, "1 " * 100_000):
        P.base_spans(text)
    many = "1.2.3.4 some word " * 40_000 + "\n" * 1000
    assert len(P.near_terms(many, P.base_spans(many), P.line_starts(many))) > 300_000
    assert P.base_spans("x 4111 1111 1111 1111, 10.0.0.256 1.2.3.4 +49 (30) 123-4567") == slow("x 4111 1111 1111 1111, 10.0.0.256 1.2.3.4 +49 (30) 123-4567")


def test_digest_and_disclosure(spark):
    rows = [(i, f"line {i} hello world\nthe vicar of dibley{i % 5} writes from jo.doe@mail.org today number {i}\nbye") for i in range(6)]
    rows += [(100 + i, f"plain text {i} about nothing\nmore plain words here from number\nthe writes today") for i in range(60)]
    rows += [(7, None), (8, ""), (8, ""), (None, "mail a@b.c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = P.op7_pii(df).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        t = text[r["doc_id"]] or ""
        want = [f"{P.KINDS[k]}:{a}:{b}" for a, k, b in slow(t)]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[1] == i for x in slow(t)) for i in range(4)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == want
        masked = {t[int(s.split(":")[1]):int(s.split(":")[2])] for s in r["spans"].split(",") if s.startswith("term")}
        if r["doc_id"] in range(6):  # only ever near the address, against words that are common elsewhere
            assert "vicar" in masked and "today" not in masked
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(df).collect()}
    assert "jo.doe" not in clean[0] and "vicar" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == text[100] and clean[7] is None
    assert P.op7_pii(df.limit(0)).count() == 0


def test_copies_do_not_hide_a_disclosing_term(spark):
    for copies in (1, 100, 1000):
        rows = [(i, f"mail jo.doe@mail.org for the vicar today, note {chr(97 + i % 3) * 4}") for i in range(3 * copies)]
        rows += [(10_000 + i, f"plain words {chr(97 + i % 26)}{chr(97 + i // 26) * 3} for the rest today") for i in range(400)]
        got = {r["doc_id"]: r for r in P.op7_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        text = dict(rows)
        for i in (0, 1, 3 * copies - 1):
            masked = {text[i][int(s.split(":")[1]):int(s.split(":")[2])] for s in got[i]["spans"].split(",") if s.startswith("term")}
            assert "vicar" in masked and "today" not in masked, (copies, masked)


def test_disclosing_terms_of_the_whole_line_and_document(spark):
    gap = " ".join(["so on and on"] * 20)
    rows = [(i, f"vicar {gap} mail jo.doe@mail.org {gap} 李明 has K7 in q{i}\nthen the vicar, 李明 or K7 again\nso on and on") for i in range(5)]
    rows += [(100 + i, f"so on and on {i}\nmail then has the or in again\nthe vicarage of K77 and 李明明") for i in range(60)]
    text = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in P.op7_pii(df).collect():
        masked = [text[r["doc_id"]][int(s.split(":")[1]):int(s.split(":")[2])] for s in r["spans"].split(",") if s.startswith("term")]
        assert sorted(masked) == (sorted(["vicar", "李明", "K7"] * 2) if r["doc_id"] < 100 else []), masked
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(df).collect()}
    assert not any(w in clean[0] for w in ("vicar", "李明", "K7", "jo.doe")) and clean[100] == text[100]


def test_entity_lines_are_linear():
    many = "1.2.3.4 some word " * 40_000 + "\n" * 1000 + "9.9.9.9 x"
    got = P.entity_lines(many, P.base_spans(many), P.line_starts(many))
    assert [x[1:] for x in got.values()] == [(["ip:1.2.3.4"], ["some", "word"]), (["ip:9.9.9.9"], ["x"])]
