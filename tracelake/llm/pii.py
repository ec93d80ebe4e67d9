"""Personal information in free text, replaced by typed placeholders.

Each text is normalised with its offsets kept: a transducer undoes look-alike
characters, full-width forms, invisible characters, spelled digits and at/dot
disguises. Identifiers are detected in the normalised text and their spans are
mapped back, so that everything outside a span stays as it was, byte for byte.

Defined results: null and empty texts hold nothing and stay as they are; spans of
two types never overlap (the earlier type of ``TYPES`` wins); repeated record ids
give one row per type.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.textform import CYRILLIC_AS, CYRILLIC_LIKE, GREEK_AS, GREEK_LIKE, char_table
from tracelake.plans.cut import cut

#: In order of precedence.
TYPES = ("email", "id_number", "phone", "address", "person")

#: Up to so many distinct names go to every task; with more, the pairs of words that may be names are joined with the table.
MAX_PEOPLE = 20_000
#: The bitmap of surnames that spares those joins most words has two to this power bits, however many names there are.
FILTER_BITS = 22

# ---- normalisation with offsets

#: Digits as words.
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ноль": 0, "один": 1, "два": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9,
}
_DIGIT_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?i)\b(?:{_DIGIT_WORD})(?:[\s,-]+(?:{_DIGIT_WORD})){{4,}}\b")
_AT = re.compile(r"(?i)\s*[\[({<]\s*(?:at|собака|эт)\s*[\])}>]\s*|(?<=[\w+]) @ (?=[\w-]+\.\w)|(?<=[\w+])\s+(?:at|собака)\s+(?=[\w-]+(?:\s+(?:dot|точка)\s+|\s*[\[({]\s*(?:dot|точка)|\.)\s*\w)")
_BRACKETED_ET = re.compile(r"(?i)[\[({<]\s*эт")
_DOT = re.compile(r"(?i)\s*[\[({<]\s*(?:dot|точка)\s*[\])}>]\s*")
_PLAIN_DOT = re.compile(r"(?i)(?<=[\w-])\s+(?:dot|точка)\s+(?=\w)")
_ODD = re.compile(r"[^\x00-\x7fЀ-ԯ№«»—–…º]")
_TWO_SCRIPTS = re.compile(r"[A-Za-z0-9._+-]*[A-Za-z][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-z0-9]")
_LATIN = {ord(a): b for a, b in zip(CYRILLIC_LIKE + GREEK_LIKE, CYRILLIC_AS + GREEK_AS)}
#: What (?i) takes for the same letter besides its upper and lower case.
_SAME_CASE = str.maketrans("ſıİ\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86\u1c87", "siiвдосттъѣ")
_MIXED_WORD = re.compile(r"[^\W_]*(?:[A-Za-z][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-z])[^\W_]*")


class Aligned:
    """A normalised text; ``starts[i]`` and ``ends[i]`` bound the source of character i."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def _offsets(self) -> tuple[list[int], list[int]]:
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        return self.starts, self.ends

    def characters(self, table: dict[int, str]) -> None:
        starts, ends = self._offsets()
        out, s, e = [], [], []
        for i, c in enumerate(self.text):
            for d in table.get(ord(c), c):
                out.append(d)
                s.append(starts[i])
                e.append(ends[i])
        self.text, self.starts, self.ends = "".join(out), s, e

    def rewrite(self, pattern: re.Pattern, by) -> None:
        """Replace each match by a text; every character of it stands for the whole match."""
        spans = [(m.start(), m.end(), by(m)) for m in pattern.finditer(self.text)]
        if not spans:
            return
        starts, ends = self._offsets()
        out, s, e, at = [], [], [], 0
        for lo, hi, new in spans:
            out += (self.text[at:lo], new)
            s += starts[at:lo] + [starts[lo]] * len(new)
            e += ends[at:lo] + [ends[hi - 1]] * len(new)
            at = hi
        self.text, self.starts, self.ends = "".join(out) + self.text[at:], s + starts[at:], e + ends[at:]

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        if self.starts is None:
            return lo, hi
        return self.starts[lo], self.ends[hi - 1]


def _low(text: str) -> str:
    """Lower case, for gates: also of the letters that only patterns without case take for another."""
    return (text.translate(_SAME_CASE) if _ODD.search(text) else text).lower()


def normalise(text: str) -> Aligned:
    out = Aligned(text)
    if _ODD.search(text):
        out.characters(char_table())
    if _TWO_SCRIPTS.search(out.text):
        out.rewrite(_MIXED_WORD, lambda m: m.group().translate(_LATIN) if sum("a" <= c.lower() <= "z" for c in m.group()) * 2 >= len(m.group()) else m.group())
    low = _low(out.text)
    if "at" in low or "@" in low or "собака" in low or "эт" in low and _BRACKETED_ET.search(out.text):
        out.rewrite(_AT, lambda m: "@")
        if "@" in out.text:
            out.rewrite(_DOT, lambda m: ".")
            out.rewrite(_PLAIN_DOT, lambda m: ".")
    if sum(map(low.count, DIGIT_WORDS)) >= 5 and _SPELLED.search(out.text):
        out.rewrite(_SPELLED, lambda m: "".join(str(DIGIT_WORDS[w]) for w in re.findall(r"\w+", m.group().lower())))
    return out


# ---- detection

_EMAIL = re.compile(r"(?:mailto:)?(?<![\w.+%-])[\w][\w.+%-]*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])")
_KEY = r"""(?:ssn|social\ security(?:\ (?:number|no\.?))?|passport|паспорт\w*|снилс|инн|national\ id(?:entity)?|id\ card|identity\ card
  |personalausweis|reisepass|ausweis|tax\ (?:id|number|no\.?)|steuer-?id|dni|nie|nif|pasaporte|licen[cs]e(?:\ plate)?|driving\ licen[cs]e|driver'?s\ licen[cs]e
  |водительск\w+\ удостоверени\w+|удостоверени\w+|права)"""
_KEYED = re.compile(
    rf"(?ix)(?<!\w){_KEY}(?:\s*(?:number|no\.?|nr\.?|num\.?|номер|серия|is|:|=|№|\#))*\s*(?P<id>[A-ZА-Я]{{0,3}}[\s-]?\d[\dA-Z]*(?:[\s-]*(?:№\s*)?\d[\dA-Z]*)*)(?!\w)"
)
#: Patterns that are identity numbers by their shape: 3-2-4 digits and 3-3-3 2 digits.
_SHAPED = re.compile(r"(?<![\w.+-])(?:\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{3}[ -]\d{2})(?![\w-])")
_PHONE = re.compile(
    r"""(?x)(?<![\w.+/-])(?:
      \+\d{1,3}[ ]?\(\d{3}\)[ ]?\d{3}-\d{2}-?\d{2}
    | \+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}
    | \+\d{11,13}
    | \+\d{1,3}(?:[ .-]?\(\d{2,5}\)|[ .-]?\d{2,4})(?:[ .-]?\d{2,5}){1,3}
    | \(\d{3}\)[ ]?\d{3}[ .-]\d{2}[ .-]?\d{2}
    | \d{3}[ .-]\d{3}-\d{4}
    | \d{3}[ ]\d{3}[ ]\d{4}
    | 1[2-9]\d{2}[2-9]\d{6}
    | 8[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}
    | 0\d{2}[ ]\d{4}[ ]\d{4}
    | 0\d{2,4}[/ ]\d{5,8}
    )(?:[ ]?(?:ext\.?|x|доб\.?)[ ]?\d{1,5})?(?![\w/]|[.-]\d)"""
)
#: Nine digits, of which some may stand in the extension of a phone number.
_DIGIT_RUN = re.compile(r"\d(?:[ ().+/-]{0,2}\d){8}|\d(?:[ ().+/-]{0,2}\d){4,7} ?(?:ext|x|доб)")
_ANY_DIGIT = re.compile(r"\d")
#: A text without any of these has no keyword of ``_KEY``.
_KEY_GATE = ("ssn", "social", "passp", "pasap", "паспорт", "снилс", "инн", "national", "id card", "identity", "ausweis", "reisepass", "tax", "steuer", "dni", "nie", "nif", "licen", "удостоверен", "права")
#: Words after bare digits that make them a quantity.
_QUANTITY = re.compile(r"\s*(?:bytes?|rows?|ms|байт|строк|tokens?|токен|seq|records?)\b", re.I)

_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Crescent|Drive|Dr\.?|Way|Court|Ct\.?|Place|Square|Sq\.?|Terrace|Boulevard|Blvd\.?|Hill|Gardens|Grove|Mews|Row)"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)"
_CAP = r"(?-i:[A-Z][\w'-]*)"
_ADDRESS_EN = re.compile(rf"(?i)(?:{_UNIT} \d+\w?, )?(?<![\w.:#/-])\d{{1,5}}[a-z]? (?:{_CAP} ){{1,3}}{_STREET}(?!\w)(?:, {_UNIT} \d+\w?)?(?:, {_CAP}(?:,? [A-Z]{{1,2}}\d{{1,2}} ?\d[A-Z]{{2}})?)?")
_ADDRESS_EN_LOW = re.compile(rf"(?:(?i:{_UNIT}) \d+\w?, )?(?<![\w.:#/-])\d{{1,4}}[a-z]? [a-z]{{5,}} (?:street|road|avenue|crescent|lane|close)\b(?=[.,;]|$| last| has|\n)(?:, (?i:{_UNIT}) \d+)?")
_RU_KIND = r"(?:ул\.|улица|улице|пр-т|проспект|просп\.|пр\.|пер\.|переулок|пл\.|площадь|бул\.|бульвар|б-р|ш\.|шоссе|наб\.|набережная)"
_RU_TAIL = r"(?:,? (?:дом |д\. ?)?\d+[а-яa-z]?(?:/\d+)?)(?:,? (?:корп\.|корпус|к\.|стр\.) ?\d+)?(?:,? (?:кв\.|квартира|оф\.|офис) ?\d+)?"
_ADDRESS_RU = re.compile(rf"(?i)(?:(?<!\w)(?:г\.|город) ?[А-ЯЁ][\w-]+, )?(?<!\w)(?:{_RU_KIND} ?[А-ЯЁ][\w-]+(?: [А-ЯЁ][\w-]+)?|[А-ЯЁ][\w-]+(?:ая|ий|ый|ой|ое) {_RU_KIND}){_RU_TAIL}")
_ADDRESS_DE = re.compile(r"(?i)(?<!\w)[A-ZÄÖÜ][\wäöüß-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer) \d{1,4}[a-z]?(?!\w)(?:, \d{5} [A-ZÄÖÜ][\w-]+)?")
_ADDRESS_ES = re.compile(r"(?i)(?<!\w)(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/) ?(?:de(?: la| los| las)? )?[A-ZÁÉÍÓÚÑ][\w-]+,? \d{1,4}(?:, \d+\.?[ºª] ?[A-Z]?)?(?!\w)")
#: Each pattern behind a cheap necessary condition.
_ADDRESSES = (
    (re.compile(r"\d(?i:[a-z])? [A-Z][\w'-]* (?i:[a-z])"), _ADDRESS_EN),
    (re.compile(r"\d[a-z]? [a-z]{5,} [slarc]"), _ADDRESS_EN_LOW),
    (re.compile(r"(?:ул\.|улиц|пр-т|просп|пр\.|пер\.|переул|пл\.|площад|бул|б-р|ш\.|шоссе|наб)", re.I), _ADDRESS_RU),
    (re.compile(r"(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee|ring|damm|ufer) \d", re.I), _ADDRESS_DE),
    (re.compile(r"calle|avenida|avda|plaza|paseo|camino|c/", re.I), _ADDRESS_ES),
)

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _forms(name: str) -> set[str]:
    """A name and its Russian cases, lower case."""
    name = name.lower()
    if not re.search(r"[а-яё]$", name):
        return {name, name + "s"} if name.isascii() else {name}
    if name.endswith(("ов", "ев", "ёв", "ин", "ын")):
        return {name + x for x in ("", "а", "у", "ым", "ом", "е", "ой", "ы", "ых", "ыми")}
    if name.endswith(("ский", "цкий", "ой", "ый", "ий")):
        return {name} | {name[:-2] + x for x in ("ого", "его", "ому", "ему", "им", "ым", "ом", "ем", "ая", "ой", "ую", "ие", "их")}
    if name.endswith(("а", "я")):
        return {name} | {name[:-1] + x for x in ("ы", "и", "е", "у", "ю", "ой", "ей")}
    if name.endswith(("й", "ь")):
        return {name} | {name[:-1] + x for x in ("я", "ю", "ем", "е")}
    return {name + x for x in ("", "а", "у", "ом", "ем", "е")}


class People:
    """Persons by the written forms of their surnames."""

    def __init__(self, names: list[str]):
        self.by_surname: dict[str, list[tuple[frozenset[str], str]]] = {}
        for full in names:
            for surname, given, first in _written(full):
                self.by_surname.setdefault(surname, []).append((given, first))

    def surname(self, word: str) -> bool:
        return word in self.by_surname

    def given(self, surname: str, word: str) -> bool:
        return any(word in given for given, _ in self.by_surname[surname])

    def initial(self, surname: str, letter: str) -> bool:
        return any(letter == first for _, first in self.by_surname[surname])


def _written(full: str | None) -> list[tuple[str, frozenset[str], str]]:
    """(surname, given names, initial) in each written form of a name's surname; nothing for less than two words."""
    words = (full or "").split()
    if len(words) < 2:
        return []
    given = frozenset(_forms(words[0]))
    return [(form, given, words[0][0].lower()) for form in sorted(_forms(words[-1]))]


class Asked:
    """Takes down what a text asks of the table of persons; ``bits`` has the surnames, and some other words."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.seen = bits, set()

    def surname(self, word: str) -> bool:
        at = zlib.crc32(word.encode()) >> (32 - FILTER_BITS)
        return bool(self.bits[at >> 6] >> (at & 63) & 1)

    def given(self, surname: str, word: str) -> bool:
        self.seen.add((surname, word, False))
        return False

    def initial(self, surname: str, letter: str) -> bool:
        self.seen.add((surname, letter, True))
        return False


class Answers:
    """The persons of one text: the pairs that it asked for and the table has."""

    def __init__(self, pairs):
        self.pairs = {(s, other, short) for s, other, short in pairs}
        self.surnames = {s for s, _, _ in self.pairs}

    def surname(self, word: str) -> bool:
        return word in self.surnames

    def given(self, surname: str, word: str) -> bool:
        return (surname, word, False) in self.pairs

    def initial(self, surname: str, letter: str) -> bool:
        return (surname, letter, True) in self.pairs


def name_spans(text: str, people: People | Asked | Answers) -> list[tuple[int, int]]:
    low = text.lower()
    words = [(m.start(), m.end(), low[m.start() : m.end()]) for m in _WORD.finditer(text)]
    out, taken = [], -1
    for i, (lo, hi, word) in enumerate(words):
        if not people.surname(word):
            continue
        best = None
        for j in (i - 1, i + 1):
            if not 0 <= j < len(words):
                continue
            l2, h2, near = words[j]
            gap = text[h2:lo] if j < i else text[hi:l2]
            if j < i:
                full = re.fullmatch(r",?\s+", gap)
                short = re.fullmatch(r"\.\s*", gap)
            else:
                full = short = re.fullmatch(r",?\s+", gap)
                short = short and text[h2 : h2 + 1] == "."
            if full and people.given(word, near):
                best = (min(lo, l2), max(hi, h2))
                break
            # a second name's initial between the given name and the surname
            if short and j < i and len(near) == 1 and i >= 2 and text[words[i - 2][1] : l2].isspace() and people.given(word, words[i - 2][2]):
                best = (words[i - 2][0], hi)
                break
            initials = near.split("-")
            if short and all(len(x) == 1 for x in initials) and text[l2].isupper() and people.initial(word, initials[0]):
                best = (min(lo, l2), max(hi, h2 + (j > i)))
                break
            # two initials before the surname, the nearer one being a second name
            if short and j < i and len(near) == 1 and i >= 2 and len(words[i - 2][2]) == 1 and text[words[i - 2][1] : l2].strip() == "." and people.initial(word, words[i - 2][2]):
                best = (words[i - 2][0], hi)
                break
        if best and best[0] >= taken:
            out.append(best)
            taken = best[1]
    return out


def detect(text: str, people: People | Answers) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) in ``text``, in order, without overlap."""
    aligned = normalise(text)
    t = aligned.text
    found: list[tuple[int, int, str]] = []

    def add(lo: int, hi: int, kind: str) -> None:
        if all(hi <= a or b <= lo for a, b, _ in found):
            found.append((lo, hi, kind))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            add(m.start(), m.end(), "email")
    if _ANY_DIGIT.search(t):
        low = _low(t)
        if any(map(low.__contains__, _KEY_GATE)):
            for m in _KEYED.finditer(t):
                if sum(c.isdigit() for c in m["id"]) >= 6:
                    add(*m.span("id"), "id_number")
        run = _DIGIT_RUN.search(t)
        for m in _SHAPED.finditer(t) if run else ():
            add(m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(t) if run else ():
            if not (m.group().isdigit() and _QUANTITY.match(t, m.end())) and 9 <= sum(c.isdigit() for c in m.group()) <= 17:
                add(m.start(), m.end(), "phone")
        for gate, pattern in _ADDRESSES:
            if gate.search(t):
                for m in pattern.finditer(t):
                    add(m.start(), m.end(), "address")
    for lo, hi in name_spans(t, people):
        add(lo, hi, "person")
    return sorted((*aligned.source(lo, hi), kind) for lo, hi, kind in found)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for lo, hi, kind in spans:
        out += (text[at:lo], f"[{kind.upper()}]")
        at = hi
    return "".join(out) + text[at:]


# ---- Spark


def _name_pairs(people: DataFrame) -> DataFrame:
    """(surname, other, short): every written surname with every written given name, and, where ``short``, with the initial."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, o, short) for full in batch["full_name"] for s, given, first in _written(full) for o, short in [*((g, False) for g in given), (first, True)]]
            yield pd.DataFrame(rows, columns=["surname", "other", "short"]).astype({"surname": object, "other": object, "short": bool})

    return people.select("full_name").mapInPandas(run, "surname string, other string, short boolean").distinct()


def _answers(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(digest, pairs): of each text that may name persons, the pairs of words that the table of persons has."""
    pairs = cut(_name_pairs(people))
    slot = F.shiftright(F.crc32("surname"), 32 - FILTER_BITS)
    rows = pairs.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(crc32(surname), {32 - FILTER_BITS}) & 63 as int))")).alias("bits")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)  # at most so many rows reach the driver
    for at, value in rows:
        bits[at] = value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, text in zip(batch["digest"], batch["content"]):
                asked = Asked(bits)
                name_spans(normalise(text).text, asked)
                out += [(digest, *pair) for pair in asked.seen]
            yield pd.DataFrame(out, columns=["digest", "surname", "other", "short"]).astype({"digest": object, "surname": object, "other": object, "short": bool})

    asked = texts.where("content <> ''").select(F.md5("content").alias("digest"), "content").mapInPandas(run, "digest string, surname string, other string, short boolean").distinct()
    return asked.join(pairs, ["surname", "other", "short"], "left_semi").groupBy("digest").agg(F.collect_list(F.struct("surname", "other", "short")).alias("pairs"))


def redacted(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(record_id, content, pii_types) from (record_id, content): placeholders in place, types in ``TYPES`` order."""
    rows = people.select("full_name").where("full_name is not null").distinct().limit(MAX_PEOPLE + 1).collect()
    names = sorted(r[0] for r in rows) if len(rows) <= MAX_PEOPLE else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        persons = People(names) if names is not None else None
        for batch in batches:
            seen: dict[str, tuple[str, list[str]]] = {}  # short texts repeat within a batch
            out, kinds = [], []
            pairs = batch["pairs"] if persons is None else [None] * len(batch)
            for text, own in zip(batch["content"], pairs):
                if not text:
                    out.append(text)
                    kinds.append([])
                    continue
                got = seen.get(text)
                if got is None:
                    spans = detect(text, persons or Answers(() if own is None else [(p["surname"], p["other"], p["short"]) for p in own]))
                    got = seen[text] = (redact(text, spans) if spans else text, [k for k in TYPES if any(s[2] == k for s in spans)])
                out.append(got[0])
                kinds.append(got[1])
            yield pd.DataFrame({"record_id": batch["record_id"], "content": pd.Series(out, index=batch.index, dtype=object), "pii_types": kinds})

    texts = texts.select("record_id", "content")
    if names is None:
        answers = _answers(texts, people)
        texts = texts.withColumn("digest", F.md5("content")).join(answers, "digest", "left").select("record_id", "content", "pairs")
    return texts.mapInPandas(run, "record_id string, content string, pii_types array<string>")


def found(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(record_id, pii_type): each type that a record's text holds at least once."""
    return redacted(texts, people).select("record_id", F.explode("pii_types").alias("pii_type")).distinct()
