"""Personal data, and the terms around it that give it away.

Four kinds are found by pattern: email, ip, card (Luhn) and phone. Then information-theoretic
sanitisation: the corpus is read as a set of lines. For a protected entity ``e`` (a normalised value
found by pattern) and a term ``t`` of a line with it, ``PMI(t; e) = log2(n(t, e) * N / (n(t) * n(e)))`` tells how
many bits of ``e`` the term reveals, against ``IC(e) = log2(N / n(e))`` bits in all. A term (a run of letters
and digits of any length) whose share ``PMI / IC`` reaches the disclosure threshold is masked wherever it
stands in a document that holds that entity: a term that is still frequent elsewhere is generalised to
its shape class, a rarer one removed.

All four counts, ``n(t, e)``, ``n(t)``, ``n(e)`` and ``N``, are of the lines of the whole corpus, copies
included; as plain copies are no evidence, a term must besides stand with the entity in ``MIN_LINES``
distinct lines. One pass over the texts finds the patterns and the lines that hold any (in Python, one
Arrow batch at a time), one counts terms, and one finds the terms to mask in the texts that have some.

Entities and terms of a line are paired in Spark, and only where a pair can still count: both in
``MIN_LINES`` distinct lines, and ``n(t) <= N^(1 - threshold) * n(e)^threshold``, which the threshold implies as
``n(t, e) <= n(e)``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import arrow_function, bound_arrow, fresh, materialize, text_key

KINDS = ("email", "ip", "card", "phone")
#: distinct lines in which a term must stand with an entity
MIN_LINES = 3
#: share of an entity's information that a term may reveal
DISCLOSURE = 0.5
#: a masked term in at least this many lines is generalised, a rarer one removed
GENERALISE_LINES = 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: only around each ``@``."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all personal data found by pattern, sorted; kinds index ``KINDS``."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def entity_name(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:" + (value.lower() if kind < 2 else "".join(_DIGITS.findall(value)))


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def free_terms(text: str, spans: list[tuple[int, int, int]], a: int, b: int):
    """Matches of the terms of ``text[a:b]`` that lie outside all sorted ``spans``."""
    i, end = bisect_left(spans, (a,)), 0  # spans may nest, but stay in their line
    for m in _TERM.finditer(text, a, b):
        while i < len(spans) and spans[i][0] < m.end():
            end = max(end, spans[i][2])
            i += 1
        if end <= m.start():
            yield m


def entity_lines(text: str, spans: list[tuple[int, int, int]], heads: list[int]) -> dict[int, tuple[int, list[str], list[str]]]:
    """Per number of a line with entities: its digest, its distinct entities and its distinct terms outside all spans.

    ``heads`` are the starts of the lines. A long line with many entities costs no more than its length.
    """
    held: dict[int, list] = {}
    for span in spans:
        held.setdefault(bisect_right(heads, span[0]) - 1, []).append(span)
    out = {}
    for n, mine in held.items():
        a, b = heads[n], heads[n + 1] - 1 if n + 1 < len(heads) else len(text)
        entities = dict.fromkeys(entity_name(k, text[x:y]) for x, k, y in mine)
        terms = dict.fromkeys(m[0].lower() for m in free_terms(text, mine, a, b))
        out[n] = (xxhash.xxh64_intdigest(text[a:b].encode()) - (1 << 63), list(entities), list(terms))
    return out


def near_terms(text: str, spans: list[tuple[int, int, int]], heads: list[int], width: int = 10):
    """``(entity, term, start, end)`` of the ``width`` terms on either side of each entity in its line, outside all spans.

    For reading only: what is masked comes from whole lines and documents. Linear in the text and what is returned.
    """
    out, lines = [], {}
    for start, kind, stop in spans:
        n = bisect_right(heads, start) - 1
        if n not in lines:
            a, b = heads[n], heads[n + 1] - 1 if n + 1 < len(heads) else len(text)
            terms = [m.span() for m in free_terms(text, spans, a, b)]
            lines[n] = [t[0] for t in terms], [t[1] for t in terms]
        starts, ends = lines[n]
        before, after = bisect_right(ends, start), bisect_left(starts, stop)
        for k in [*range(max(0, before - width), before), *range(after, min(len(starts), after + width))]:
            out.append((entity_name(kind, text[start:stop]), text[starts[k]:ends[k]].lower(), starts[k], ends[k]))
    return out


FOUND = ("struct<spans:array<struct<start:int,kind:int,stop:int>>,n_lines:long,"
         "lines:array<struct<line:long,copies:long,entities:array<string>,terms:array<string>>>>")


@arrow_function(FOUND)
def find(texts: pa.Array) -> pa.Array:
    spans, n_lines, lines = [], [], []
    for t in texts.to_pylist():
        t = t or ""
        s = base_spans(t)
        spans.append([{"start": a, "kind": k, "stop": b} for a, k, b in s])
        n_lines.append(t.count("\n") + 1)
        mine: dict[int, dict] = {}
        for digest, entities, terms in entity_lines(t, s, line_starts(t)).values() if s else ():
            mine.setdefault(digest, {"line": digest, "copies": 0, "entities": entities, "terms": terms})["copies"] += 1
        lines.append(list(mine.values()))
    i32, i64, st = pa.int32(), pa.int64(), pa.string()
    return pa.StructArray.from_arrays([
        pa.array(spans, pa.list_(pa.struct([("start", i32), ("kind", i32), ("stop", i32)]))), pa.array(n_lines, i64),
        pa.array(lines, pa.list_(pa.struct([("line", i64), ("copies", i64), ("entities", pa.list_(st)), ("terms", pa.list_(st))])))],
        ["spans", "n_lines", "lines"])


@arrow_function("array<struct<term:string,lines:long>>")
def line_terms(texts: pa.Array) -> pa.Array:
    """The terms of a text and the number of its lines that hold each."""
    out = []
    for t in texts.to_pylist():
        n: dict[str, int] = {}
        for line in (t or "").split("\n"):
            for w in {x.lower() for x in _TERM.findall(line)}:
                n[w] = n.get(w, 0) + 1
        out.append([{"term": w, "lines": c} for w, c in n.items()])
    return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("lines", pa.int64())])))


def scan(docs: DataFrame) -> DataFrame:
    """One written row per document: ``doc_id, text_sha, spans, n_lines, lines``; no text."""
    bound_arrow(docs.sparkSession)
    found = docs.select("doc_id", text_key(F.col("text")).alias("text_sha"), find(F.coalesce("text", F.lit(""))).alias("f"))
    return materialize(found.select("doc_id", "text_sha", "f.*"), "pii-scan")


def disclosing_terms(docs: DataFrame, scanned: DataFrame, min_lines: int = MIN_LINES, threshold: float = DISCLOSURE) -> DataFrame:
    """``entity, term, share, term_lines``: the terms that reveal at least ``threshold`` of an entity."""
    empty = docs.sparkSession.createDataFrame([], "entity string, term string, share double, term_lines long")
    held = scanned.filter(F.size("lines") > 0).select(F.explode("lines").alias("x")).select("x.*")
    lines = materialize(held.groupBy("line").agg(F.sum("copies").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "pii-lines")
    of_line = lines.select("line", "copies", F.explode("entities").alias("entity"))
    n_e = of_line.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_lines)
    entities = materialize(of_line.join(n_e.drop("k"), "entity"), "pii-entities")
    if entities.isEmpty():
        return empty
    of_line = lines.join(entities.select("line").distinct(), "line", "left_semi").select("line", F.explode("terms").alias("term"))
    often = of_line.groupBy("term").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_lines)
    n_t = docs.select(F.explode(line_terms(F.coalesce("text", F.lit("")))).alias("t")).groupBy("t.term").agg(F.sum("t.lines").alias("n_t"))
    total = float(scanned.agg(F.sum("n_lines").alias("n")).first()["n"])
    most = float(entities.agg(F.max("n_e").alias("n")).first()["n"])
    # 1 % above the bound, as powers round
    bound = lambda n: 1.01 * F.pow(F.lit(total), F.lit(1 - threshold)) * F.pow(n, F.lit(threshold))
    terms = materialize(often.select("term").join(n_t, "term").filter(F.col("n_t") <= bound(F.lit(most))), "pii-terms")
    pairs = entities.join(of_line.join(terms, "term"), "line").filter(F.col("n_t") <= bound(F.col("n_e")))
    both = (pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("k"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
            .filter(F.col("k") >= min_lines))
    n = F.lit(total)
    pmi = F.log2(F.col("n_te") * n / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.try_divide(pmi, F.log2(n / F.col("n_e")))
    return (both.filter(F.col("n_e") < n).withColumn("share", share).filter(F.col("share") >= threshold)
            .select("entity", "term", "share", F.col("n_t").alias("term_lines")))


@arrow_function("array<struct<start:int,stop:int,action:string>>")
def _occurrences(texts: pa.Array, terms: pa.Array) -> pa.Array:
    """All places of each text's ``terms`` (term, action) outside the spans found by pattern."""
    out = []
    for t, held in zip(texts.to_pylist(), terms.to_pylist()):
        action = {x["term"]: x["action"] for x in held}
        out.append([{"start": m.start(), "stop": m.end(), "action": action[w]}
                    for m in free_terms(t, base_spans(t), 0, len(t)) if (w := m[0].lower()) in action])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("action", pa.string())])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha, base, terms``: per document the spans by pattern, and the terms that disclose an entity it holds."""
    scanned = scan(docs)
    reveal = materialize(disclosing_terms(docs, scanned), "pii-reveal")
    base = scanned.select("doc_id", "text_sha", F.col("spans").alias("base"))
    if reveal.isEmpty():
        return base.withColumn("terms", F.lit(None).cast("array<struct<start:int,stop:int,action:string>>"))
    holds = scanned.filter(F.size("lines") > 0).select("text_sha", F.explode(F.flatten("lines.entities")).alias("entity")).distinct()
    action = F.when(F.col("term_lines") >= GENERALISE_LINES, F.lit("generalise")).otherwise(F.lit("remove"))
    masks = holds.join(reveal, "entity").groupBy("text_sha").agg(F.collect_set(F.struct("term", action.alias("action"))).alias("mask"))
    masks = materialize(masks, "pii-masks")
    texts = docs.select("text", text_key(F.col("text")).alias("text_sha")).join(masks, "text_sha")
    terms = materialize(texts.select("text_sha", _occurrences("text", "mask").alias("terms")).dropDuplicates(["text_sha"]), "pii-places")
    return base.join(terms, "text_sha", "left")


def op7_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of ``docs``; null and empty texts have none.

    ``spans`` adds kind ``term``, which sorts after the base kinds. Repeated rows are all returned.
    """
    found = find_personal_data(docs)
    kind = F.array(*[F.lit(k) for k in KINDS])
    name = lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    terms = F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,action:string>>"))
    span = lambda k: (lambda s: F.struct(s["start"].alias("start"), k(s).alias("kind"), s["stop"].alias("stop")))
    every = F.array_sort(F.concat(F.transform("base", span(lambda s: s["kind"])),
                                  F.array_distinct(F.transform(terms, span(lambda s: F.lit(len(KINDS)))))))
    named = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    full = lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))],
                        F.sha2(F.array_join(F.transform("base", name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(every, full), ",").alias("spans"), F.size(terms).cast("long").alias("n_term"))


@arrow_function("string")
def _mask(texts: pa.Array, base: pa.Array, terms: pa.Array) -> pa.Array:
    out = []
    for t, b, s in zip(texts.to_pylist(), base.to_pylist(), terms.to_pylist()):
        marks = [(x["start"], x["stop"], f"<{KINDS[x['kind']].upper()}>") for x in b or []]
        marks += [(x["start"], x["stop"], "<TERM>" if x["action"] == "generalise" else "") for x in s or []]
        parts, at = [], 0
        for a, e, to in sorted(marks):
            if a >= at:
                parts += [t[at:a], to]
            at = max(at, e)
        out.append(None if t is None else "".join([*parts, t[at:]]))
    return pa.array(out, pa.string())


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised ``text``: base spans become ``<KIND>``, disclosing terms ``<TERM>`` or nothing.

    What is masked depends on the text (and the corpus), so rows are matched by text digest.
    """
    key, base, terms, k = fresh(docs.columns, "pii_text", "pii_base", "pii_terms", "pii_key")
    found = find_personal_data(docs).filter(F.size("base") > 0).dropDuplicates(["text_sha"])
    found = found.select(F.col("text_sha").alias(k), F.col("base").alias(base), F.col("terms").alias(terms))
    keyed = docs.withColumn(key, text_key(F.col("text")))
    out = keyed.join(found, F.col(key) == F.col(k), "left")
    return out.select(*[F.when(F.col(k).isNull(), F.col(c)).otherwise(_mask("text", base, terms)).alias(c) if c == "text" else F.col(c)
                        for c in docs.columns])
