"""Evaluation texts leaking into training text.

Items are partitioned by size. Each partition has passages of one length, the
shortest item of the partition, and both sides are cut into all of their passages of
that length: a short item inside a long document becomes two passages of the same
size, whose MinHash over shingles of five words agrees with certainty where one is
contained in the other, so that one hash per passage misses nothing. Runs of
neighbouring passages share their minimum, so a document gives about two hashes for
nine words, each with the words of its run.

A bitmap of fixed size of the items' hashes goes to the documents: hashes that no item
has stay where they are, and no document's text is moved. What is left meets the items
by size and hash and is verified by exact shingle containment: runs of shingles in the
same order in both. Runs of neighbouring passages are joined by their place.

Texts are compared as words: in capitals, where the look-alike letters of all
scripts take their Latin shape, without invisible characters, punctuation, markup
and line breaks.

Defined results: an item of ``PASSAGE`` words or more is held where that many consecutive
words are; a shorter one as a whole, where asked for; null and empty texts and items of fewer words
than a shingle match nothing; repeated ids count once per id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.textform import CYRILLIC_LIKE, GREEK_LIKE, char_table, skeleton
from tracelake.plans.cut import cut

SHINGLE = 5
PASSAGE = 12
#: Lengths in words of the passages of each size partition, by the least size of its items.
SIZES = (5, 8, PASSAGE)
#: The bitmap of the items' hashes has two to this power bits for each size partition, however many items there are.
FILTER_BITS = 22
#: Texts are hashed together up to this many characters.
TOGETHER = 1_000_000

_MARKUP = re.compile(r"<[^<>]{1,200}>|&(?:[a-z]{2,8}|#\d+);|!?\[([^\[\]]*)\]\([^()\s]*\)", re.I)
_HYPHEN_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t\r]*\n\s*(?=[^\W\d_])")


_MARKS = re.compile("[\u0300-\u036f]")
_ASCII = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_LIKE = frozenset((CYRILLIC_LIKE + GREEK_LIKE).upper())


class _Capitals(dict):
    """What characters of a text in capitals become; filled as characters turn up."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = char_table().get(point, c)
        if c in _LIKE or unicodedata.decomposition(c):
            out = skeleton(c)
        if len(out) == 1 and not out.isalnum() and not _MARKS.match(out):
            out = " "
        self[point] = out.upper()
        return self[point]


_CAPITALS = _Capitals()


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(lambda m: m[1] or " ", text)
    if "-\n" in text or "-\r" in text:
        text = _HYPHEN_BREAK.sub("", text)
    text = text.replace("'", "").replace("’", "").upper()
    if text.isascii():
        return text.translate(_ASCII).split()
    text = text.translate(_CAPITALS)
    if _MARKS.search(text):
        text = unicodedata.normalize("NFC", text)
    return text.split()


#: Hashes of the words that this process has met lately.
_KNOWN: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def passage_marks(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, MinHash, first word, word after the last) of all passages of ``size`` words, neighbours with the same hash as one."""
    if len(_KNOWN) > 200_000:
        _KNOWN.clear()
    for tokens in texts:
        for w in set(tokens).difference(_KNOWN):
            _KNOWN[w] = xxhash.xxh64_intdigest(w)
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    if total < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    base = np.fromiter(map(_KNOWN.__getitem__, chain.from_iterable(texts)), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n = total - SHINGLE + 1
    shingles = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            shingles = (shingles ^ base[k : k + n]) * _MIX
            shingles ^= shingles >> np.uint64(29)
    n = total - size + 1
    low = shingles[:n].copy()
    for k in range(1, size - SHINGLE + 1):
        np.minimum(low, shingles[k : k + n], out=low)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    low, owner = low[at], owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    start = (np.cumsum(lengths) - lengths)[owner[first]]
    return owner[first], low[first], at[first] - start, at[last] - start + size


def _slots(marks: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((marks * _MIX) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def common_runs(document: list[str], item: list[str]) -> list[tuple[int, int, int]]:
    """(place in ``document``, place in ``item``, length) of the longest common runs of words, of ``SHINGLE`` words or more."""
    places: dict[tuple, list[int]] = {}
    for i in range(len(item) - SHINGLE + 1):
        places.setdefault(tuple(item[i : i + SHINGLE]), []).append(i)
    out, open_at = [], {}
    for j in range(len(document) - SHINGLE + 2):
        now = {}
        for i in places.get(tuple(document[j : j + SHINGLE]), ()):
            now[i] = open_at.pop(i - 1, i)
        out += [(j - 1 - i + begun, begun, i - begun + SHINGLE) for i, begun in open_at.items()]
        open_at = now
    return out


def _passages(rows: DataFrame, key: str, text: str, sizes: tuple[int, ...], held: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(key, size, mark, slot, start, words, n_words): the passages of each row; with ``held`` only those with a bit in its bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["key"].to_numpy(), batch["text"].tolist()
            start, weight = 0, 0
            for end, t in enumerate(texts, 1):
                weight += len(t)
                if weight >= TOGETHER or end == len(texts):
                    own, split = keys[start:end], [words(t) for t in texts[start:end]]
                    for size in sizes:
                        owner, marks, lo, hi = passage_marks(split, size)
                        slots = _slots(marks)
                        if held is not None:
                            keep = (held[size][slots >> 6] >> (slots & 63)) & 1 == 1
                            owner, marks, slots, lo, hi = (x[keep] for x in (owner, marks, slots, lo, hi))
                        said = [" ".join(split[o][a:b]) for o, a, b in zip(owner, lo, hi)]
                        yield pd.DataFrame({"key": own[owner], "size": size, "mark": marks.view(np.int64), "slot": slots, "start": lo, "words": pd.Series(said, dtype=object), "n_words": [len(split[o]) for o in owner]})
                    start, weight = end, 0

    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return rows.mapInPandas(run, "key bigint, size int, mark bigint, slot bigint, start bigint, words string, n_words bigint")


def _bitmaps(wanted: DataFrame) -> dict[int, np.ndarray]:
    """The slots of the items' hashes by size; at most 2**FILTER_BITS / 64 rows a size reach the driver."""
    bits = wanted.groupBy("size", F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect()
    out: dict[int, np.ndarray] = {}
    for size, at, value in bits:
        out.setdefault(size, np.zeros((1 << FILTER_BITS) // 64, np.int64))[at] = value
    return out


def leaks(documents: DataFrame, items: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, item_id, run_words, item_words): documents that hold ``PASSAGE`` consecutive words of an item; with ``short``
    also those that hold a shorter item, of ``SHINGLE`` words or more, as a whole."""
    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("item_text"))
    wanted = _passages(items, "item_id", "item_text", SIZES if short else (PASSAGE,))
    # an item's partition is the last one whose passages it is long enough for
    partition = F.element_at(F.filter(F.array(*map(F.lit, SIZES)), lambda x: x <= F.col("n_words")), -1)
    wanted = cut(wanted.where(F.col("size") == (partition if short else F.lit(PASSAGE))))
    held = _bitmaps(wanted)
    found = _passages(documents, "doc_id", "text", tuple(sorted(held)), held)
    pairs = found.select(F.col("key").alias("doc_id"), "size", "mark", F.col("start").alias("doc_at"), F.col("words").alias("doc_words")).join(
        wanted.select(F.col("key").alias("item_id"), "size", "mark", F.col("start").alias("item_at"), F.col("words").alias("item_words"), "n_words"), ["size", "mark"]
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, item, at, d, low, i, n in zip(batch["doc_id"], batch["item_id"], batch["doc_at"], batch["doc_words"], batch["item_at"], batch["item_words"], batch["n_words"]):
                rows += [(doc, item, at + x - low - y, at + x, at + x + length, n) for x, y, length in common_runs(d.split(" "), i.split(" "))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "shift", "lo", "hi", "n_words"])

    runs = pairs.mapInPandas(verify, "doc_id bigint, item_id bigint, shift bigint, lo bigint, hi bigint, n_words bigint").distinct()
    # runs of one shift that touch are one run; a pair and shift has at most as many as the item has words
    place = Window.partitionBy("doc_id", "item_id", "shift").orderBy("lo", "hi")
    top = F.max("hi").over(place.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("fresh", F.coalesce((F.col("lo") > top).cast("int"), F.lit(1)))
    runs = runs.withColumn("nth", F.sum("fresh").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("doc_id", "item_id", "shift", "nth").agg((F.max("hi") - F.min("lo")).alias("run_words"), F.max("n_words").alias("item_words"))
    return whole.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words")).where(F.col("run_words") >= F.least(F.lit(PASSAGE), F.col("item_words")))
