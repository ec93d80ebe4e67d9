"""Text functions as columns: terms, relevance, redaction, reduction signals.

Case is folded with ``lower``; a term is a run of letters, digits and ``_ . / : -``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_./:-]+"

# Credential patterns, in the order in which they apply.
SECRET_RULES = (
    ("openai_key", r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED:openai_key]"),
    ("github_token", r"\bgh[opusr]_[A-Za-z0-9]{20,}\b", "[REDACTED:github_token]"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED:aws_access_key]"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}", "[REDACTED:bearer_token]"),
    ("assigned_secret", r"(?i)(\b(?:api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*)([^\s,;]{6,})", "$1[REDACTED]"),
    ("private_key", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED:private_key]"),
)
# Signs of failures, warnings and summaries in tool output.
FAILURE = r"(?i)(?:\bFAIL(?:ED|URE)?\b|\bERROR\b|\bFATAL\b|\bPANIC\b|AssertionError|Traceback|Exception|segmentation fault|npm ERR!)"
WARNING = r"(?i)(?:\bWARN(?:ING)?\b|deprecated|flaky|retry)"
SUMMARY = r"(?i)(?:^=+\s*\d+\s+(?:passed|failed|error|skipped)|^\d+\s+(?:passed|failed|skipped|errors?)(?:\s|,|$)|^tests?\s+(?:run|passed|failed)|test result:|finished in)"
PATH_LINE = r"(?:^|\s)([^\s:]+\.(?:py|js|ts|tsx|rs|go|java|cs|cpp|c|h)):(\d+)"
TERMINAL_ESCAPE = r"\x1b(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
# Families of commands, first match wins.
FAMILIES = (
    ("test", ("pytest", "unittest", "cargo test", "go test", "npm test", "pnpm test", "yarn test", "dotnet test")),
    ("diff", ("git diff", "git show")),
    ("status", ("git status",)),
    ("search", ("rg ", "grep ", "findstr", "select-string")),
    ("source", ("cat ", "get-content", "read_file", "read file")),
    ("build", ("npm install", "pnpm install", "cargo build", "cargo check", "compile", "docker build", "pip install")),
)


def terms(text: Column) -> Column:
    """Distinct terms of two characters or more, lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1))


def lexical_relevance(query: str, text: Column) -> Column:
    """Coverage, precision and phrase score of a text for a fixed query, 0 to 1; one half for a query without terms."""
    wanted = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1))
    own = terms(text)
    both = F.size(F.array_intersect(wanted, own))
    score = 0.7 * both / F.size(wanted) + 0.15 * F.sqrt(both / F.greatest(F.size(own), F.lit(1))) + F.when(F.contains(F.lower(text), F.lower(F.lit(query))), 0.15).otherwise(0.0)
    return F.when(F.size(wanted) == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), score))


def freshness(age_days: Column, half_life_days: float) -> Column:
    return F.exp(-math.log(2) * F.greatest(age_days, F.lit(0.0)) / half_life_days)


def exact_identifiers(text: Column) -> Column:
    """Opaque ids of a text, lower case: prefixed ids, or hex runs with a digit and a letter."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])(?:[0-9a-fA-F]{7,64}|(?:evt|mem|op|task)_[0-9A-Za-z]+)(?![0-9A-Za-z_])"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda x: x.rlike("^(?:evt|mem|op|task)_") | (x.rlike("[0-9]") & x.rlike("[a-f]"))))


def token_estimate(text: Column) -> Column:
    """Cautious token count: a third of the UTF-8 bytes or 1.35 per word, whichever is more, at least 1; 0 for no text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    most = F.greatest(F.ceil(F.octet_length(text) / 3), F.ceil(words * 1.35), F.lit(1))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(most).cast("bigint")


def redact_secrets(text: Column) -> Column:
    """All rules one after the other; later rules see what earlier ones put in."""
    for _, pattern, by in SECRET_RULES:
        text = F.regexp_replace(text, pattern, by)
    return text


def secret_counts(text: Column) -> Column:
    """How often each rule applies, as a struct by rule."""
    out = []
    for name, pattern, by in SECRET_RULES:
        out.append(F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).alias(name))
        text = F.regexp_replace(text, pattern, by)
    return F.struct(*out)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def normalized_key(text: Column) -> Column:
    return F.lower(collapse(text))


def preview(text: Column, size: int = 160) -> Column:
    return F.substring(collapse(text), 1, size)


def escape_untrusted(text: Column, tag: str = "untrusted") -> Column:
    """The text inside a tag that it cannot close."""
    return F.concat(F.lit(f"<{tag}>\n"), F.replace(text, F.lit(f"</{tag}>"), F.lit(f"&lt;/{tag}&gt;")), F.lit(f"\n</{tag}>"))


def lines(text: Column) -> Column:
    """Lines without carriage returns and trailing blanks."""
    return F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def first_failure_line(text: Column) -> Column:
    hits = F.filter(F.transform(lines(F.regexp_replace(text, TERMINAL_ESCAPE, "")), collapse), lambda x: x.rlike(FAILURE))
    return F.substring(F.try_element_at(hits, F.lit(1)), 1, 240)


def family(command: Column) -> Column:
    low, out = F.lower(command), None
    for name, words in FAMILIES:
        hit = low.rlike("|".join(w.replace(".", r"\.") for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def critical_signals(text: Column, paths: bool = False) -> Column:
    """The distinct lines that report a failure or a summary, lower case; with ``paths`` also path:line places."""
    clean = F.filter(F.transform(lines(text), collapse), lambda x: x != "")

    def signal(x: Column) -> Column:
        place = F.concat(F.lower(F.regexp_extract(x, PATH_LINE, 1)), F.lit(":"), F.regexp_extract(x, PATH_LINE, 2))
        whole = F.when(x.rlike(FAILURE) | x.rlike(SUMMARY), F.lower(x))
        return F.when(F.lit(paths) & x.rlike(PATH_LINE), place).otherwise(whole)

    return F.array_distinct(F.filter(F.transform(clean, signal), lambda x: x.isNotNull()))


def containment(a: Column, b: Column) -> Column:
    """Shared terms over the smaller term set, 0 where one is empty."""
    x, y = terms(a), terms(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a string in a text."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("bigint")


def date_signals(at: Column) -> Column:
    """The date in words of two languages, for search."""
    english, russian = (
        "January February March April May June July August September October November December".split(),
        "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(),
    )
    month = F.month(at)
    en, ru = F.element_at(F.array(*map(F.lit, english)), month), F.element_at(F.array(*map(F.lit, russian)), month)
    day, year = F.dayofmonth(at).cast("string"), F.year(at).cast("string")
    return F.concat_ws(" ", en, day, year, day, ru, year)


def file_signals(files: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(files, lambda f: F.substring_index(F.replace(f, F.lit("\\"), F.lit("/")), "/", -1)), lambda x: x != "")), " ")
