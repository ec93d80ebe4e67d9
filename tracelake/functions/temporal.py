"""Three-valued temporal predicates over envelopes.

A bound is an envelope struct (lo, hi, singleton): an instant, a half-open range,
or open on either side where lo or hi is null. Predicates are nullable booleans:
null is unknown, and SQL's AND, OR and NOT are the logic's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

bound_type = "timestamp_ntz"


def envelope(bound: Column, precision: Column) -> Column:
    """The envelope of a timestamp known to a precision; unknown precision or a null bound is open on both sides."""
    day = F.date_trunc("day", bound)
    month, year = F.date_trunc("month", bound), F.date_trunc("year", bound)
    lo = F.when(precision == "day", day).when(precision == "month", month).when(precision == "year", year).when(precision == "instant", bound)
    hi = (
        F.when(precision == "day", day + F.expr("INTERVAL 1 DAY"))
        .when(precision == "month", month + F.expr("INTERVAL 1 MONTH"))
        .when(precision == "year", year + F.expr("INTERVAL 1 YEAR"))
        .when(precision == "instant", bound)
    )
    known = bound.isNotNull() & precision.isin("day", "month", "year", "instant")
    none = F.lit(None).cast(bound_type)
    return F.struct(F.when(known, lo).otherwise(none).alias("lo"), F.when(known, hi).otherwise(none).alias("hi"), F.coalesce(known & (precision == "instant"), F.lit(False)).alias("singleton"))


def instant(at: Column) -> Column:
    return F.struct(at.alias("lo"), at.alias("hi"), F.lit(True).alias("singleton"))


def lt3(a: Column, b: Column) -> Column:
    """True if every instant of ``a`` lies before every one of ``b``, false if none can."""
    sure = (
        F.when(a["singleton"] & b["singleton"], a["lo"] < b["lo"])
        .when(a["singleton"], a["lo"] < b["lo"])
        .when(b["singleton"], a["hi"] <= b["lo"])
        .otherwise(a["hi"] <= b["lo"])
    )
    able = (
        F.when(a["singleton"] & b["singleton"], a["lo"] < b["lo"])
        .when(b["singleton"], F.coalesce(a["lo"] < b["lo"], F.lit(True)))
        .otherwise(F.coalesce(a["lo"] < b["hi"], F.lit(True)))
    )
    return F.when(F.coalesce(sure, F.lit(False)), F.lit(True)).when(~able, F.lit(False))


def le3(a: Column, b: Column) -> Column:
    return ~lt3(b, a)


def eq3(a: Column, b: Column) -> Column:
    apart = F.coalesce(lt3(a, b), F.lit(False)) | F.coalesce(lt3(b, a), F.lit(False))
    return F.when(a["singleton"] & b["singleton"], a["lo"] == b["lo"]).when(apart, F.lit(False))


def contains3(start: Column, end: Column, point: Column) -> Column:
    """Whether the half-open interval holds the point."""
    return le3(start, point) & lt3(point, end)


def overlaps3(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return lt3(a[0], b[1]) & lt3(b[0], a[1])


def validity_status(start: Column, end: Column, now: Column) -> Column:
    """current, not_yet_valid, expired, current_open or unknown, tested in this order.

    ``start`` and ``end`` are envelopes, ``now`` an instant's envelope.
    """
    open_end = end["lo"].isNull() & end["hi"].isNull()
    holds = contains3(start, end, now)
    return (
        F.when(holds, "current")
        .when(lt3(now, start), "not_yet_valid")
        .when(~open_end & le3(end, now), "expired")
        .when(le3(start, now) & open_end, "current_open")
        .otherwise("unknown")
    )


def effective_end(end: Column, successor_start: Column) -> Column:
    """A known end stands; an open one is closed by a known start of the successor."""
    open_end = end["lo"].isNull() & end["hi"].isNull()
    known_next = successor_start["lo"].isNotNull() | successor_start["hi"].isNotNull()
    return F.when(open_end & F.coalesce(known_next, F.lit(False)), successor_start).otherwise(end)


def interval_error(start: Column, end: Column) -> Column:
    """inverted or empty where the interval cannot hold anything, else null."""
    return F.when(lt3(end, start), "inverted").when(eq3(start, end), "empty")


def coarse_age(seconds: Column) -> Column:
    """under a minute, minutes, hours or days, as text."""
    return (
        F.when(seconds < 60, "under a minute")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )


# Words for days, for windows some time ago (days back to the start and to the end) and for the period before this one.
DAY_WORDS = (("today", 0), ("сегодня", 0), ("yesterday", -1), ("вчера", -1), ("tomorrow", 1), ("завтра", 1))
AGO = (
    ("a couple of days ago|пару дней назад", 3, 1),
    ("a few days ago|несколько дней назад", 5, 2),
    ("a couple of weeks ago|пару недель назад", 21, 7),
    ("a few weeks ago|несколько недель назад", 35, 14),
    ("a few months ago|несколько месяцев назад", 150, 60),
)
LAST = (("last week|на прошлой неделе|прошлую неделю", "week"), ("last month|в прошлом месяце|прошлый месяц", "month"), ("last year|в прошлом году|прошлый год", "year"))
# Names of the months in their written forms; those that are other words too count only with a year.
MONTH_NAMES = (
    "january январь января январе", "february февраль февраля феврале", "march март марта марте", "april апрель апреля апреле", "may май мая мае", "june июнь июня июне",
    "july июль июля июле", "august август августа августе", "september сентябрь сентября сентябре", "october октябрь октября октябре", "november ноябрь ноября ноябре", "december декабрь декабря декабре",
)
WITH_YEAR = ("may", "march", "august")


def whole_words(pattern: str) -> str:
    """A pattern, in group 2, that no letter or digit touches."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])"


_PLAIN = "|".join(w for names in MONTH_NAMES for w in names.split() if w not in WITH_YEAR)
#: A month's name in group 3 or 5, its year in group 4 or 6.
MONTH = whole_words(rf"({_PLAIN})(?:\.?\s+(\d{{4}}))?|({'|'.join(WITH_YEAR)})\.?\s+(\d{{4}})")
ISO_DAY = whole_words(r"\d{4}-\d{2}-\d{2}")


def _window(start: Column, end: Column, words: Column) -> Column:
    return F.struct(start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"), words.alias("expression"))


def query_window(text: Column, now: Column) -> Column:
    """The window (start, end, expression) that a text names first by rank, half-open, null if none; the expression is in lower case.

    Ranked: a written day, some time ago, a day by name, the period before this one, a month with or without a year;
    a month without one is the last that is not in the future. A written day that no calendar has is none.
    """
    # patterns without case know only Latin letters
    text, day = F.lower(text), F.date_trunc("day", now)
    after = lambda start, n: start + F.make_dt_interval(days=F.lit(n))
    months = lambda start, n: F.add_months(start.cast("date"), n)
    written = F.regexp_extract(text, ISO_DAY, 2)
    at = F.try_to_date(written, "yyyy-MM-dd").cast("timestamp_ntz")
    found = [F.when(at.isNotNull(), _window(at, after(at, 1), written))]
    for words, back, until in AGO:
        hit = F.regexp_extract(text, whole_words(words), 2)
        found.append(F.when(hit != "", _window(after(day, -back), after(day, -until), hit)))
    for word, offset in DAY_WORDS:
        found.append(F.when(text.rlike(whole_words(word)), _window(after(day, offset), after(day, offset + 1), F.lit(word))))
    # the first period in the text, whichever it is
    last = F.regexp_extract(text, whole_words("|".join(words for words, _ in LAST)), 2)
    for words, unit in LAST:
        start = F.date_trunc(unit, now)
        before = after(start, -7) if unit == "week" else months(start, -1 if unit == "month" else -12)
        found.append(F.when((last != "") & last.rlike(f"(?i)^(?:{words})$"), _window(before, start, last)))
    part = lambda n: F.regexp_extract(text, MONTH, n)
    name, year = F.lower(F.concat(part(3), part(5))), F.concat(part(4), part(6))
    number = F.coalesce(*[F.when(name.isin(*names.split()), n) for n, names in enumerate(MONTH_NAMES, 1)])
    own = F.when(year != "", year.try_cast("int")).otherwise(F.year(now) - F.when(number > F.month(now), 1).otherwise(0))
    first = F.make_date(F.when(own >= 1, own), number, F.lit(1))
    found.append(F.when((name != "") & first.isNotNull(), _window(first, months(first, 1), part(2))))
    return F.coalesce(*found)


def parsed_bound(raw: Column, anchor: Column) -> Column:
    """What a written bound stands for: (lo, hi, precision, error).

    A year, a month, a day, an instant with its zone, or today, yesterday, tomorrow of the anchor. Nothing written is unknown;
    an instant without a zone is ``naive_timestamp``, a relative day without an anchor ``relative_without_anchor``, a date that
    no calendar has ``invalid_calendar_value``, anything else ``unparseable_temporal``.
    """
    text, none = F.trim(raw), F.lit(None).cast("timestamp_ntz")
    low = F.lower(text)
    span = lambda lo, hi, precision: F.struct(lo.cast("timestamp_ntz").alias("lo"), hi.cast("timestamp_ntz").alias("hi"), F.lit(precision).alias("precision"), F.lit(None).cast("string").alias("error"))
    wrong = lambda error: F.struct(none.alias("lo"), none.alias("hi"), F.lit(None).cast("string").alias("precision"), F.lit(error).alias("error"))
    out = F.when(F.coalesce(text, F.lit("")) == "", span(none, none, "unknown"))
    for word, offset in DAY_WORDS:
        day = F.date_trunc("day", anchor) + F.make_dt_interval(days=F.lit(offset))
        out = out.when((low == word) & anchor.isNull(), wrong("relative_without_anchor")).when(low == word, span(day, day + F.make_dt_interval(days=F.lit(1)), "day"))
    for pattern, precision, tail, n in ((r"^\d{4}$", "year", "-01-01", 12), (r"^\d{4}-\d{2}$", "month", "-01", 1), (r"^\d{4}-\d{2}-\d{2}$", "day", "", 0)):
        start = F.try_to_date(F.concat(text, F.lit(tail)), "yyyy-MM-dd")
        end = F.add_months(start, n) if n else F.date_add(start, 1)
        out = out.when(text.rlike(pattern) & start.isNotNull(), span(start, end, precision)).when(text.rlike(pattern), wrong("invalid_calendar_value"))
    clock = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"
    at = text.try_cast("timestamp").cast("timestamp_ntz")
    zoned = text.rlike(clock + r"(?:Z|[+-]\d{2}:\d{2})$")
    return out.when(zoned & at.isNotNull(), span(at, at, "instant")).when(text.rlike(clock + "$"), wrong("naive_timestamp")).otherwise(wrong("unparseable_temporal"))
