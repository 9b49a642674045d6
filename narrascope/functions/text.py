"""Scalar text functions: Column in, Column out, JVM-side only.

Every function is a composition of built-in expressions so that it stays
inside whole-stage code generation (or, for the higher-order array
functions, inside one projection); no Python runs per row.
"""

from __future__ import annotations

import html.entities
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrascope.functions.arrays import bind_value

# ---------------------------------------------------------------------------
# Fixed values. Python's ``str.isspace`` set, spelled out because Java's and
# RE2's ``\s`` are ASCII-only: tab, LF, VT, FF, CR, the four separators
# U+001C-U+001F, space, NEL, NBSP, OGHAM SPACE MARK, U+2000-U+200A, LINE
# SEPARATOR, PARAGRAPH SEPARATOR, NNBSP, MMSP, IDEOGRAPHIC SPACE.
WS_CLASS = (r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Python's Unicode ``\w``: letters, numbers, underscore.
WORD_CLASS = r"\p{L}\p{N}_"
# Tokens the treebank word tokenizer splits in two even without
# punctuation (fixed values): cannot, gimme, gonna, gotta, lemme, wanna.
SPLIT_CONTRACTIONS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
# What windows-1252 has at 128-159; a place it leaves undefined stands for itself.
CP1252 = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
# Elements whose text does not count (fixed values): script, style, template, and ruby annotations.
SILENT_ELEMENTS = ("script", "style", "template", "rt", "rp")
# ---------------------------------------------------------------------------

SENTENCE_MARK = "\u0001"  # control character; removed from tokens by T1


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def remove_images(col) -> Column:
    """Delete ``<img ...>`` tags (lower-case tag name only)."""
    return F.regexp_replace(_c(col), r"<img[^>]*>", "")


def code_point_to_string(n: Column) -> Column:
    """One code point as a string (``chr`` wraps at 256, so go via UTF-32); 128-159 as windows-1252."""
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    enc = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(n.between(128, 159), F.substr(F.lit(CP1252), n.cast("int") - 127, F.lit(1)))
            .when(valid, enc).otherwise(F.lit("\ufffd")))


def entity_names() -> dict[str, str]:
    """HTML's named character references, without the semicolon, from the standard library's table."""
    return {k.rstrip(";"): v for k, v in html.entities.html5.items()}


def decode_entities(col) -> Column:
    """Decode ``&name;``, ``&#NNN;`` and ``&#xHHH;`` references; the semicolon may be missing.

    A name counts only as a whole (up to the next character that is no letter or digit); an unknown one is
    left alone. The common names are tried before the whole table.
    """
    names = entity_names()
    common = ("amp", "lt", "gt", "quot", "nbsp", "apos")
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")

    def piece(p: Column, i: Column) -> Column:
        dec = F.regexp_extract(p, "^#([0-9]+)", 1)
        hexa = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+)", 1)
        name = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*)", 1)
        known = F.lit(None).cast("string")
        for n in common:
            known = F.when(name == n, F.lit(names[n])).otherwise(known)
        known = F.when(name != "", F.coalesce(known, F.try_element_at(table, name)))
        rest = lambda taken: F.regexp_replace(p, f"^{taken};?", "")
        number = lambda x, base: F.coalesce(F.when(F.length(x) <= 12, F.conv(x, base, 10).cast("long")), F.lit(-1).cast("long"))
        return (
            F.when(i == 0, p)
            .when(dec != "", F.concat(code_point_to_string(number(dec, 10)), rest("#[0-9]+")))
            .when(hexa != "", F.concat(code_point_to_string(number(hexa, 16)), rest("#[xX][0-9a-fA-F]+")))
            .when(known.isNotNull(), F.concat(known, rest("[A-Za-z][A-Za-z0-9]*")))
            .otherwise(F.concat(F.lit("&"), p))
        )

    decoded = lambda x: F.array_join(F.transform(F.split(x, "&", -1), piece), "")
    return bind_value(_c(col), lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x))


def strip_html(col) -> Column:
    """Text of an HTML fragment, joined with no separator.

    Comments and the bodies of elements whose text does not count are dropped (as the pinned parser
    does), then every tag (a quoted attribute value may hold ``>``), then character references are
    decoded; null gives ''.
    """
    def untagged(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?s)<!--.*?(-->|\z)", "")
        for name in SILENT_ELEMENTS[:2]:
            x = F.regexp_replace(x, rf"(?is)<{name}\b.*?(</{name}\s*>|\z)", "")
        for name in SILENT_ELEMENTS[2:]:
            x = F.regexp_replace(x, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
        x = F.regexp_replace(x, r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", "")
        return F.regexp_replace(x, r"<(/?[A-Za-z]|!|\?)[^>]*>", "")

    # every pattern begins with the sign, so a text without it is left alone
    return decode_entities(bind_value(F.coalesce(_c(col), F.lit("")), lambda x: F.when(F.contains(x, F.lit("<")), untagged(x)).otherwise(x)))


def normalize_whitespace(col) -> Column:
    """Every whitespace run becomes one space, then trim; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), f"[{WS_CLASS}]+", " "))


def normalize_text(col) -> Column:
    """strip_html then normalize_whitespace."""
    return normalize_whitespace(strip_html(col))


def content_hash(title, summary) -> Column:
    """C4: md5 hex of ``lower(title || '|' || summary)``."""
    return F.md5(F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit("|"),
                                  F.coalesce(_c(summary), F.lit("")))))


def article_text(title="title", summary="summary", sep: str = ". ") -> Column:
    """``title<sep>summary`` with nulls as ''."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(sep), F.coalesce(_c(summary), F.lit("")))


def strip_non_word(col) -> Column:
    """Drop every character that is neither a word character nor whitespace."""
    return F.regexp_replace(_c(col), f"[^{WORD_CLASS}{WS_CLASS}]", "")


def _drop_urls(x: Column) -> Column:
    """``http`` + non-space run deleted (``x`` is used twice: bound)."""
    return F.when(F.contains(x, F.lit("http")), F.regexp_replace(x, f"http[^{WS_CLASS}]+", "")).otherwise(x)


def _edges(x: Column) -> Column:
    """True if ``x`` begins or ends with whitespace."""
    return F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(f"[{WS_CLASS}]")


def _stripped(x: Column) -> Column:
    """``x`` (used several times: bound) without whitespace at both ends."""
    return F.when(_edges(x), F.regexp_replace(x, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")).otherwise(x)


def clean_for_tokens(col) -> Column:
    """Lower, drop ``http`` + non-space run, drop punctuation (underscore kept)."""
    return strip_non_word(bind_value(F.lower(F.coalesce(_c(col), F.lit(""))), _drop_urls))


def split_words(col) -> Column:
    """Whitespace split, empties dropped, fixed contractions split in two."""
    special = F.array(*[F.lit(w) for w in SPLIT_CONTRACTIONS])
    parts = lambda x: F.array_remove(F.split(x, f"[{WS_CLASS}]+"), "")
    halved = lambda x: F.flatten(F.transform(parts(x), lambda t: F.when(
        F.array_contains(special, F.lower(t)),
        F.array(F.substring(t, 1, 3), F.substring(t, 4, 10))).otherwise(F.array(t))))
    # a search in the whole text first: most texts hold no contraction, so their tokens are not looked at one by one
    held = lambda x: bind_value(F.lower(x), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in SPLIT_CONTRACTIONS]))
    return bind_value(_c(col), lambda x: F.when(held(x), halved(x)).otherwise(parts(x)))


def tokenize(col) -> Column:
    """Word tokens of T1-cleaned text, as ``array<string>``."""
    return split_words(clean_for_tokens(col))


def clean_for_sentences(col) -> Column:
    """lower, drop URLs, newline to space, strip; punctuation kept."""
    x = bind_value(F.lower(F.coalesce(_c(col), F.lit(""))), _drop_urls)
    return bind_value(F.replace(x, F.lit("\n"), F.lit(" ")), _stripped)


def split_sentences(col) -> Column:
    """sentences end after ``.``, ``!`` or ``?`` followed by whitespace."""
    def cut(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, f"([.!?]+)[{WS_CLASS}]+", "$1" + SENTENCE_MARK), SENTENCE_MARK, -1)
        # a sentence's end takes all whitespace after it, so only the ends of the text and a mark of its own leave some
        loose = F.contains(x, F.lit(SENTENCE_MARK)) | _edges(x)
        return F.array_remove(F.when(loose, F.transform(parts, _stripped)).otherwise(parts), "")

    return bind_value(_c(col), cut)


def word_tokens_lower(col) -> Column:
    """Tokens of a lowered, punctuation-free string (entity and sentence tokens in F3)."""
    return split_words(strip_non_word(F.lower(_c(col))))
