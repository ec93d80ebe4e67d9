"""Views of long tool outputs, as columns over arrays of lines: what a reader needs first, without losing what must stay.

Case and order of lines are kept; a line that is chosen twice stands once, at its first place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import text as X

#: Lines kept at either end, around a sign, of warnings; tokens under which an output stands as it is.
HEAD = TAIL = 24
RADIUS = 2
WARNINGS = 12
LEAST_TOKENS = 160
#: Families whose output is never shortened.
WHOLE = ("source", "diff", "status")


def lines(text: Column) -> Column:
    """Lines without terminal escapes, trailing blanks and empty lines at either end."""
    text = F.regexp_replace(F.regexp_replace(text, X.TERMINAL_ESCAPE, ""), r"\r\n?", "\n")
    return F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def _failed(x: Column) -> Column:
    return x.rlike(X.FAILURE)


def _salient(x: Column) -> Column:
    return x.rlike(X.FAILURE) | x.rlike(X.WARNING)


def _tail(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n)


def around(rows: Column, hit: Callable[[Column], Column], radius: int = RADIUS) -> Column:
    """The lines within ``radius`` lines of a hit."""
    return F.filter(rows, lambda _, i: F.exists(F.slice(rows, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1), hit))


def test_view(rows: Column) -> Column:
    """Failures with the lines around them, the last warnings and the summaries; the end, if there are none."""
    parts = F.array_distinct(F.concat(around(rows, _failed), _tail(F.filter(rows, lambda x: x.rlike(X.WARNING)), WARNINGS), F.filter(rows, lambda x: x.rlike(X.SUMMARY))))
    return F.when(F.size(parts) > 0, parts).otherwise(_tail(rows, TAIL))


def search_view(rows: Column) -> Column:
    """Every place path:line once, then failures and warnings that name no place."""
    places = F.array_distinct(F.transform(F.flatten(F.transform(rows, lambda x: F.regexp_extract_all(x, F.lit(X.PATH_LINE), F.lit(0)))), lambda x: F.trim(x)))
    return F.concat(places, F.filter(rows, lambda x: ~x.rlike(X.PATH_LINE) & _salient(x)))


def build_view(rows: Column) -> Column:
    """Failures and warnings with the lines around them, then the rest of the end."""
    near = around(rows, _salient)
    return F.concat(near, F.array_except(_tail(rows, TAIL), near))


def collapsed(rows: Column) -> Column:
    """Runs of one line as the line and a note of how often it came again."""
    starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i) != F.get(rows, i - 1)))

    def run(i: Column, k: Column) -> Column:
        more = F.coalesce(F.get(starts, k + 1), F.size(rows)) - i - 1
        return F.when(more > 0, F.array(F.get(rows, i), F.format_string("[previous line repeated %d more times]", more))).otherwise(F.array(F.get(rows, i)))

    return F.flatten(F.transform(starts, run))


def generic_view(rows: Column) -> Column:
    """Runs collapsed; of many lines the head, a note, what is salient and the tail. ``rows`` are ``collapsed`` lines."""
    head = F.concat(F.slice(rows, 1, HEAD), F.array(F.format_string("[... %d middle lines omitted ...]", F.size(rows) - HEAD - TAIL)))
    return F.when(F.size(rows) <= HEAD + TAIL, rows).otherwise(F.concat(head, F.array_except(around(rows, _salient), head), _tail(rows, TAIL)))


def protected(view: Column, rows: Column, pattern: str) -> Column:
    """A view with the protected lines that it lacks, in their order, under a heading."""
    lost = F.filter(rows, lambda x: x.rlike(pattern) & ~F.array_contains(view, x))
    return F.when(F.size(lost) > 0, F.concat(view, F.array(F.lit("[protected lines]")), lost)).otherwise(view)


def framed(body: Column, name: Column, tokens: Column) -> Column:
    """A view's text under a line that says of what it is a view."""
    return F.concat(F.lit("[view of "), name, F.lit(", "), tokens.cast("string"), F.lit(" tokens]\n"), body)
