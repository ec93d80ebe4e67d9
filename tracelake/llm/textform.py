"""One form for visually identical text.

ASCII text without control blanks is stable as it is. In other text a quick check finds
the segments that may be unstable: a run of letters with a character that composition or
the tables below may change (the properties of Unicode's normalisation quick check: it is
replaced, it has a combining class, or it may combine with the character before), a word
of two scripts, and a word of look-alike letters that shows no script. Each segment is normalised with
its boundary context: all letters and marks that touch it, the character before it if it
starts with a mark, and the script that the text before it shows. The canonical segments
are spliced into the text, which is unchanged elsewhere.

Case, accents, digits and words stay different; script, width, kind of blank and
invisible characters do not count. A look-alike letter is written in the script
that the other letters of its word show; if they show none, in the script of the
nearest word before it that shows one, else in Latin. Both depend on nothing but
what the text looks like, so texts that look the same come out equal.

Defined results: null stays null, the empty text stays empty, nothing is trimmed.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.plans.cut import cut

#: Letters that look alike, Cyrillic or Greek over Latin.
CYRILLIC_LIKE = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХІЈЅУԌԚԜ"
CYRILLIC_AS = "aeopcyxijshdqwlABEKMHOPCTXIJSYGQW"
GREEK_LIKE = "ορνιαυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ"
GREEK_AS = "opviauyABEZHIKMNOPTYXcj"

_TO_LATIN = dict(zip(CYRILLIC_LIKE, CYRILLIC_AS)) | dict(zip(GREEK_LIKE, GREEK_AS))
_TO_CYRILLIC = {latin: letter for letter, latin in zip(CYRILLIC_LIKE, CYRILLIC_AS)}
#: Characters without ink that are not of category Cf.
_NO_INK = "͏ᅟᅠ឴឵ㅤﾠ"


@cache
def char_table() -> dict[int, str]:
    """What single characters become before composition; made from the Unicode data by rule."""
    out: dict[int, str] = {}
    for point in range(128, sys.maxunicode + 1):
        ch = chr(point)
        kind = unicodedata.category(ch)
        if kind == "Cn" or kind == "Cs" or kind == "Co":
            continue
        if kind == "Cf" or ch in _NO_INK or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            out[point] = ""
        elif kind == "Zs" or ch == "⠀":
            out[point] = " "
        elif kind in ("Zl", "Zp") or ch == "\x85":
            out[point] = "\n"
        elif unicodedata.decomposition(ch).split(" ")[0] in ("<wide>", "<narrow>", "<font>"):
            out[point] = unicodedata.normalize("NFKC", ch)
    for ch in "\t\x0b\x0c":
        out[ord(ch)] = " "
    return out


def _ranges(points: list[int]) -> str:
    parts, points = [], sorted(points)
    start = last = points[0]
    for p in [*points[1:], -9]:
        if p != last + 1:
            parts.append(re.escape(chr(start)) + ("-" + re.escape(chr(last)) if last > start else ""))
            start = p
        last = p
    return "".join(parts)


@cache
def _quick_check() -> re.Pattern:
    """Matches the segments of a text that may be unstable."""
    table = char_table()
    blanks = [p for p, to in table.items() if to in (" ", "\n")]
    letters, parts, latin, cyrillic, alike, shown = [], [], [], [], [], []
    seconds = set()  # characters that may combine with the one before
    for p in range(0x80, 0x30000):
        pieces = unicodedata.decomposition(chr(p)).split(" ")
        if len(pieces) == 2 and pieces[0][:1] != "<":
            seconds.add(int(pieces[1], 16))
    seconds |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for p in [*range(0x41, 0x30000), *(p for p in table if p >= 0x30000)]:
        c = chr(p)
        if 0xD800 <= p < 0xE000 or p in blanks:
            continue
        base = unicodedata.normalize("NFD", c)[0]
        unstable = p in table or p in seconds or unicodedata.combining(c) or c in GREEK_LIKE or base in GREEK_LIKE or not unicodedata.is_normalized("NFC", c)
        if unstable:
            (letters if c.isalpha() else parts).append(p)
        elif c.isalpha() and (base.isascii() or "Ѐ" <= base <= "ԯ"):
            (latin if base.isascii() else cyrillic).append(p)
            (alike if base in _TO_LATIN or base in _TO_CYRILLIC else shown).append(p)
    inner = rf"(?:[^\W\d_]|[{_ranges(parts)}])"
    start, alone = rf"(?<![^\W\d_])(?<![{_ranges(parts)}])", rf"(?=[^\W\d_]*[{_ranges(alike)}])(?![^\W\d_]*[{_ranges(shown)}])[^\W\d_]+"
    odd, mixed = rf"(?={inner}*[{_ranges(parts + letters)}]){inner}+", rf"(?=[^\W\d_]*[{_ranges(latin)}])(?=[^\W\d_]*[{_ranges(cyrillic)}])[^\W\d_]+"
    return re.compile(rf"\r\n?|[{_ranges(blanks)}]|{start}(?:{odd}|{mixed}|{alone})")


@cache
def _shows() -> re.Pattern:
    """Matches a letter that shows its script."""
    return re.compile("[" + _ranges([p for p in range(0x41, 0x2000) if chr(p).isalpha() and _script(chr(p))]) + "]")


def skeleton(text: str) -> str:
    """The text with every look-alike letter in its Latin shape, composed."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(char_table())
    text = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(_TO_LATIN.get(c, c) for c in text))


_WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")

def _script(word: str) -> str:
    """The script that the letters of a skeleton word show, '' if all of them look like both."""
    for c in unicodedata.normalize("NFD", word):
        if "Ѐ" <= c <= "ԯ":
            return "c"
    for c in unicodedata.normalize("NFD", word):
        if c.isascii() and c.isalpha() and c not in _TO_CYRILLIC:
            return "l"
    return ""


def _segment(text: str, script: str) -> tuple[str, str]:
    """A segment in its one form, and the script that it or else the text before it shows."""
    base = skeleton(text)
    out, at = [], 0
    for m in _WORD.finditer(base):
        word = m.group()
        script = _script(word) or script
        if script == "c":
            plain = unicodedata.normalize("NFD", word)
            word = unicodedata.normalize("NFC", "".join(_TO_CYRILLIC.get(c, c) for c in plain))
        out += (base[at : m.start()], word)
        at = m.end()
    return "".join(out) + base[at:], script


_CONTROL_BLANK = re.compile(r"[\t\r\x0b\x0c]")


def canonical(text: str | None) -> str | None:
    """The one form of ``text``."""
    if not text or text.isascii() and not _CONTROL_BLANK.search(text):
        return text
    out, at, script = [], 0, ""
    for m in _quick_check().finditer(text):
        lo, hi = m.span()
        shown = _shows().findall(text, at, lo)
        script = _script(shown[-1]) if shown else script
        if lo > at and (unicodedata.combining(text[lo]) or not text[lo].isalpha()):
            lo -= 1  # what a mark may combine with
        form, script = _segment(text[lo:hi], script)
        out += (text[at:lo], form)
        at = hi
    return "".join(out) + text[at:] if out else text


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Column form of ``canonical``."""
    return texts.map(canonical, na_action="ignore")


def _forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, form): digests of each text and of its form, made in one pass and kept for all later reads."""
    forms = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(text_col).alias("text"), F.md5(canonical_text(F.col(text_col))).alias("form"))
    return cut(forms)


def same_look_pairs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): rows whose texts look the same but are not the same string; null texts match nothing.

    Spellings of a form are paired before rows: equal copies never meet, and rows are joined only to what comes out.
    """
    forms = _forms(rows, id_col, text_col)
    # classes with one spelling drop out before any pairing
    mixed = forms.groupBy("form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("form")
    forms = forms.join(mixed, "form", "left_semi").distinct()
    spellings = forms.select("form", "text").distinct()
    pairs = spellings.join(spellings.withColumnRenamed("text", "text_b"), "form").where("text < text_b").drop("form")
    pairs = pairs.join(forms.select("id", "text"), "text").withColumnRenamed("id", "a").join(forms.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "text_b")
    return pairs.where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def look_classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_spellings): one row per row with a text; the class is named by its smallest id."""
    forms = _forms(rows, id_col, text_col)
    classes = forms.groupBy("form", "text").agg(F.min("id").alias("low")).groupBy("form").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("n_spellings"))
    return forms.join(classes, "form").select("id", "class_id", "n_spellings")


def requoted_pairs(candidates: DataFrame, examples: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: a candidate and its example, if the candidate's quote looks the
    same as an expected quote of the example but is the same string as none of them."""
    quotes = examples.select(F.col("id").alias("example_id"), F.explode("expected.evidence_quote").alias("quote")).where("quote is not null")
    quotes = cut(quotes.select("example_id", F.md5("quote").alias("text"), F.md5(canonical_text("quote")).alias("form")))
    own = candidates.where("evidence_quote is not null").select("id", "example_id", "evidence_quote").distinct()
    own = own.select("id", "example_id", F.md5("evidence_quote").alias("text"), F.md5(canonical_text("evidence_quote")).alias("form"))
    hits = own.join(quotes, ["example_id", "form"], "left_semi").join(quotes, ["example_id", "text"], "left_anti")
    return hits.select(F.least("id", "example_id").alias("id_a"), F.greatest("id", "example_id").alias("id_b")).distinct()
