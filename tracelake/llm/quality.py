"""Per-document text quality statistics and the form of the text.

Statistics are sums over a document's lines, taken where the document lies, and
repetition statistics: the shares of repeated lines and paragraphs and the part of
the characters that the most frequent word n-gram covers. Combined rules on these
tell natural prose from lists, tables and junk.

Defined results: null and empty texts are junk with zero counts and null ratios;
repeated document ids give one row per row; texts are never cut.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent words of English, Russian, German and Spanish.
COMMON = (
    "the a an of and or to in on at by for with from as is are was were be been it its this that these those which who what when where why how not no but if so than then there their they we you he she i my your our has have had do does did will would can could should only all any each more most other some such up out into over after before because about between while until since once also "
    "и в во не на я что с со а то как он она они мы вы ты но по из у к ко за от до о об для при без под над или если что чтобы так как уже же ещё еще бы был была было были есть это этот эта эти тот все всё всех только когда где потому нет да ли их его её ее им нам только пока после перед через "
    "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren es sie er wir ihr ich zu in im an am auf aus bei mit von vom für nach vor über unter dass wenn weil als auch noch nur so wie was hat haben hatte wird werden kann muss um bis "
    "el la los las un una unos unas de del y o en que no es son fue por para con sin sobre se su sus lo al como más pero si ya hay está cuando donde porque hasta desde entre muy también"
)

_BLANK = r"[\s\p{Z}\p{Cf}]"
_INTS = "words letters common vowelless hex_words long_words odd_chunks chunks ink distinct_words foreign placeholders n_plain plain_chars n_marked marked_chars n_bare bare_chars n_body n_rules bar_width bar_lines tab_width tab_lines semicolon_width semicolon_lines comma_width comma_lines gap_width gap_lines"
_SHAPE = T.StructType([T.StructField(name, T.LongType()) for name in _INTS.split()] + [T.StructField(name, T.DoubleType()) for name in ("top2", "top3", "top_words")])


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r|\x{2028}|\x{0085}")


def _visible(line: Column) -> Column:
    return F.length(F.regexp_replace(line, _BLANK, "")) > 0


def _repeated_chars(parts: str) -> Column:
    """The part of the characters of ``parts`` that stands in a part that came before."""
    size = F.length(F.array_join(parts, ""))
    return F.try_divide(size - F.length(F.array_join(F.array_distinct(parts), "")), size)


_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_HEX = re.compile(r"(?<!\S)[0-9a-fA-F]{4,}(?!\S)")
_LONG = re.compile(r"(?<!\S)[\w+/=-]{40,}(?!\S)")
_INNER_SIGN = re.compile(r"(?<=[^\W\d_])[\[\]{};<>|\\]+(?=[^\W\d_])")
_VOWEL = re.compile(r"[aeiouyаеёиоуыэюяáéíóúüäöåàèìòùâêîôûæøœ]", re.I)
_FOREIGN = re.compile("[\x80-\x9fÐÑÃÂ\ufffd]")
#: The notations of a slot that a template engine would have filled.
_SLOT = re.compile(r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|%\{[^{}\n]*\}%?|<%[^\n]*?%>|\$\{?\(?\w+\)?\}?|&#?\w+;")
_SPLIT = re.compile("\r\n|\n|\r|\u2028|\x85")
_NO_INK = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\xad]*$")
_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_MARKED = re.compile(r"\s*(?:[-*•·◦‣+–]\s+(?:\[[ xX]?\]\s*)?|\[[ xX]?\]\s+|\(?(?:\d{1,4}|[A-Za-zа-яА-Я]|[ivxlc]{1,5})[.)]\s+)")
_SENTENCE_END = re.compile(r"[^\W\d_]{2}[.!?]\s+[^\W\d_]")
_NOT_BARE = re.compile(r"[.!?:;,]\s*$|\s*#|[|\t]")
_RULE_LINE = re.compile(r"[\s|+:=_*~.-]+$")
_DASHES = re.compile(r"[-=_+]{3}")
_LIMITS = {"semicolon": re.compile(r";(?! |$)"), "comma": re.compile(r",(?! |$)"), "gap": re.compile(r"(?<=\S) {2,}(?=\S)|^ {6,}(?=\S)")}
_NOTATIONS = (("bar", "|"), ("tab", "\t"), ("semicolon", ";"), ("comma", ","), ("gap", "  "))


def _coverage(codes: np.ndarray, sizes: np.ndarray, n: int, kinds: int) -> float:
    """The part of a text's letters and digits that its most frequent run of ``n`` words covers."""
    if len(codes) < 2 * n:
        return 0.0
    grams = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        grams = grams * kinds + codes[k : len(codes) - n + 1 + k]
    ordered = np.sort(grams)
    ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    counts = np.diff(ends, prepend=-1)
    best = counts.argmax()
    if counts[best] < 2:
        return 0.0
    at = (grams == ordered[ends[best]]).argmax()
    return min(1.0, float(counts[best] * sizes[at : at + n].sum() / sizes.sum()))


def _word_counts(text: str, common: frozenset[str]) -> tuple:
    tokens = _TOKEN.findall(text.lower())
    counts = Counter(tokens)
    kinds = {t: i for i, t in enumerate(counts)}
    codes = np.fromiter(map(kinds.__getitem__, tokens), np.int64, len(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stems: Counter = Counter()
    for t, n in counts.items():
        stems[t[:-1] if t.endswith("s") else t] += n
    size = sum(n * len(t) for t, n in stems.items())
    chunks = text.split()
    odd = sum(1 for c in chunks if _INNER_SIGN.search(c)) if _INNER_SIGN.search(text) else 0
    ints = (
        len(tokens),
        sum(n * (len(t) if t.isalpha() else sum(map(str.isalpha, t))) for t, n in counts.items()),
        sum(n for t, n in counts.items() if t in common),
        sum(n for t, n in counts.items() if len(t) > 3 and t.isalpha() and not _VOWEL.search(t)),
        len(_HEX.findall(text)),
        len(_LONG.findall(text)) if len(max(chunks, key=len, default="")) >= 40 else 0,
        odd,
        len(chunks),
        sum(map(len, chunks)),
        len(counts),
        len(_FOREIGN.findall(text)),
        sum(map(len, _SLOT.findall(text))) if any(x in text for x in "{%$&") else 0,
    )
    top = sum(n * len(t) for t, n in stems.most_common(3)) / size if size else 0.0
    return ints, (_coverage(codes, sizes, 2, len(kinds)), _coverage(codes, sizes, 3, len(kinds)), top)


def _line_counts(text: str, common: frozenset[str]) -> tuple:
    lines = [x for x in _SPLIT.split(text) if not _NO_INK.match(x)]
    # code between fences counts as part of the text around it
    plain = [x for x in _SPLIT.split(_FENCE.sub("", text)) if not _NO_INK.match(x)] if "```" in text else lines
    marked = marked_chars = bare = bare_chars = 0
    for x in plain:
        if _MARKED.match(x):
            # a marked line of several sentences is a paragraph
            if len(_SENTENCE_END.findall(x)) < 2:
                marked, marked_chars = marked + 1, marked_chars + len(x)
        elif len(x) < 200 and not _NOT_BARE.search(x) and len(x.split(None, 5)) <= 4 and x.lstrip()[:1].isalnum() and not common.intersection(_TOKEN.findall(x.lower())):
            # up to four words without an end mark or function word: an entry of a list without markers
            bare, bare_chars = bare + 1, bare_chars + len(x)
    body = [x for x in lines if not _RULE_LINE.match(x)]
    rules = sum(1 for x in lines if _RULE_LINE.match(x) and _DASHES.search(x))
    columns = []
    for kind, sign in _NOTATIONS:
        if sign not in text:
            columns += (0, 0)
            continue
        pattern = _LIMITS.get(kind)
        widths = Counter()
        for x in body:
            if sign in x and not _MARKED.match(x):
                widths[len(pattern.findall(x)) if pattern else x.count(sign)] += 1
        widths.pop(0, None)
        width, times = max(widths.items(), key=lambda w: (w[1], w[0]), default=(0, 0))
        if kind == "gap" and widths:  # an empty cell of a table in fixed widths joins two gaps
            width, times = max(widths), sum(widths.values())
        columns += (width, times)
    return (len(plain), sum(map(len, plain)), marked, marked_chars, bare, bare_chars, len(body), rules, *columns)


@F.pandas_udf(_SHAPE)
def text_shape(texts: pd.Series) -> pd.DataFrame:
    """Counts over the words and lines of whole texts."""
    common = frozenset(COMMON.split())
    rows = []
    for text in texts:
        ints, ratios = _word_counts(text or "", common)
        rows.append((*ints, *_line_counts(text or "", common), *ratios))
    return pd.DataFrame(rows, columns=_SHAPE.names)


# a filter on what follows from the counts must not run the pass a second time
text_shape = text_shape.asNondeterministic()


def statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics per document row; the columns are those that ``form_rules`` reads, and more."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.where("doc_id is not null").select("doc_id", text.alias("text")).select("doc_id", "text", text_shape("text").alias("w"))
    lines, paragraphs = F.filter(_lines(F.col("text")), _visible), F.filter(F.split("text", r"(?:\r?\n[ \t]*){2,}"), _visible)
    docs = docs.withColumn("found", F.struct(lines.alias("lines"), paragraphs.alias("paragraphs")))
    words, n, blocks, ink = F.col("w.words"), F.size("found.lines"), F.size("found.paragraphs"), F.col("w.ink")
    return docs.select(
        "doc_id",
        F.length("text").alias("n_chars"),
        words.alias("n_words"),
        n.alias("n_lines"),
        F.try_divide(F.col("w.letters"), words).alias("mean_word_length"),
        F.try_divide(F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s\p{Z}]+", "")), F.length("text")).alias("symbol_ratio"),
        F.try_divide(F.size(F.filter("found.lines", lambda x: x.rlike(r"[.!?…。:;\"'»”)]\s*$"))), n).alias("punctuated_line_share"),
        F.try_divide(F.col("w.common"), words).alias("common_word_share"),
        F.try_divide(n - F.size(F.array_distinct("found.lines")), n).alias("duplicate_line_share"),
        F.try_divide(blocks - F.size(F.array_distinct("found.paragraphs")), blocks).alias("duplicate_paragraph_share"),
        _repeated_chars("found.lines").alias("duplicate_line_char_share"),
        _repeated_chars("found.paragraphs").alias("duplicate_paragraph_char_share"),
        F.col("w.top2").alias("top_bigram_coverage"),
        F.col("w.top3").alias("top_trigram_coverage"),
        F.col("w.top_words").alias("top_word_coverage"),
        F.try_divide(F.col("w.distinct_words"), words).alias("distinct_word_share"),
        F.try_divide(F.col("w.marked_chars"), F.col("w.plain_chars")).alias("marked_char_share"),
        F.try_divide(F.col("w.bare_chars"), F.col("w.plain_chars")).alias("bare_char_share"),
        *[F.col(f"w.{c}").alias(c) for c in ("n_plain", "n_marked", "n_bare", "n_body", "n_rules")],
        *[F.col(f"w.{k}_{x}").alias(f"{k}_{x}") for k, _ in _NOTATIONS for x in ("width", "lines")],
        F.try_divide(F.col("w.letters"), ink).alias("letter_share"),
        F.try_divide(F.col("w.vowelless"), words).alias("vowelless_share"),
        F.try_divide(F.col("w.hex_words"), F.col("w.chunks")).alias("hex_share"),
        F.try_divide(F.col("w.long_words"), F.col("w.chunks")).alias("long_word_share"),
        F.try_divide(F.col("w.odd_chunks"), F.col("w.chunks")).alias("inner_sign_share"),
        F.try_divide(F.col("w.foreign"), F.length("text")).alias("mojibake_share"),
        F.try_divide(F.col("w.placeholders"), ink).alias("placeholder_share"),
    )


def repetition() -> tuple[Column, Column]:
    """Whether lines or paragraphs mostly repeat others, and whether one run of words is all over the text; both say that
    a text is boilerplate and no content, whatever its words."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    repeated = (zero("duplicate_line_share") > 0.5) & (zero("duplicate_line_char_share") > 0.5) | (zero("duplicate_paragraph_share") > 0.5) & (zero("duplicate_paragraph_char_share") > 0.5)
    dominant = (zero("top_trigram_coverage") > 0.5) & (F.col("n_words") >= 10) | (zero("top_trigram_coverage") > 0.1) & (zero("distinct_word_share") < 0.25) & (F.col("n_words") >= 30)
    return repeated, dominant


def form_rules() -> Column:
    """prose, list, table or junk from the columns of ``statistics``."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    tabless = c("bar_lines") + c("tab_lines") + c("semicolon_lines") + c("comma_lines") + c("gap_lines") < 2
    entries, entry_chars = c("n_marked") + c("n_bare"), zero("marked_char_share") + zero("bare_char_share")
    listed = (c("n_marked") >= 2) & (zero("marked_char_share") >= 0.5) | (entries >= 3) & ((entry_chars >= 0.5) | (entry_chars >= 0.35) & (entries >= 0.75 * c("n_plain")))
    # a table of data may repeat its rows
    content = tabless | (zero("common_word_share") >= 0.2)
    repeated, dominant = repetition()
    junk = (
        (c("n_words") == 0)
        | repeated & (c("n_lines") >= 4) & content
        # entries of a list may share their words if the lines differ
        | dominant & content & ~(listed & (zero("duplicate_line_share") <= 0.5))
        | (zero("letter_share") < 0.25) & tabless
        | (zero("mojibake_share") > 0.1)
        | (zero("hex_share") > 0.6) & (c("n_words") >= 4)
        | (zero("long_word_share") > 0.4) & ((zero("common_word_share") < 0.05) | (zero("long_word_share") > 0.6))
        | (zero("inner_sign_share") > 0.25) & tabless
        | (zero("top_word_coverage") > 0.7) & (c("n_words") >= 6) & (zero("common_word_share") < 0.05)
        | (zero("placeholder_share") > 0.5)
        | (zero("vowelless_share") > 0.25)
        | (zero("distinct_word_share") < 0.15) & (c("n_words") >= 10) & (zero("common_word_share") < 0.2)
        | (zero("top_bigram_coverage") > 0.3) & (c("n_words") >= 10) & (zero("common_word_share") < 0.1)
        | (zero("symbol_ratio") > 0.3) & (zero("common_word_share") < 0.05) & tabless
    )
    table = F.lit(False)
    for kind, least in (("bar", 2), ("tab", 1), ("semicolon", 1), ("comma", 1), ("gap", 1)):
        table = table | ((c(f"{kind}_lines") >= 2) & (c(f"{kind}_width") >= least) & (c(f"{kind}_lines") >= 0.6 * c("n_body")))
    return F.when(junk, "junk").when(table, "table").when(listed, "list").otherwise("prose")


def forms(documents: DataFrame) -> DataFrame:
    """(doc_id, form) of each document row."""
    return statistics(documents).select("doc_id", form_rules().alias("form"))
