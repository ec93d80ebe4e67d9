"""Operators on text whose structure is nested or stateful, as Arrow batches: private regions, markdown zones,
uniform JSON arrays. Each works on one text at a time; Spark spreads the texts.

Defined results: null stays null; an unclosed private region reaches to the end; text without JSON rows gives null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.text import SECRET_RULES

_TAG = re.compile(r"<(/?)private\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.I)
_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")


def _without_private(text: str) -> tuple[str, int]:
    out, depth, at, regions = [], 0, 0, 0
    for m in _TAG.finditer(text):
        if m[1]:
            if depth:
                depth -= 1
                if not depth:
                    at = m.end()
        elif not m[2].rstrip().endswith("/"):
            if not depth:
                out += (text[at : m.start()], "[PRIVATE]")
                regions += 1
            depth += 1
    if not depth:
        out.append(text[at:])
    return "".join(out), regions


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("regions", T.IntegerType())]))
def without_private(texts: pd.Series) -> pd.DataFrame:
    """The text without its private regions, nested ones as one, and how many there were."""
    rows = [(None, 0) if t is None else _without_private(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "regions"])


@F.pandas_udf(T.StructType([T.StructField(z, T.IntegerType()) for z in ("prose", "fenced_code", "blockquote", "inline_code")]))
def zone_sizes(texts: pd.Series) -> pd.DataFrame:
    """Characters of a markdown text in prose, fenced code, block quotes and inline code."""
    rows = []
    for text in texts:
        sizes, fence = {"prose": 0, "fenced_code": 0, "blockquote": 0, "inline_code": 0}, None
        for line in (text or "").split("\n"):
            m = _FENCE.match(line)
            if fence:
                sizes["fenced_code"] += len(line)
                if m and m[1].startswith(fence) and line.strip() == m[1]:
                    fence = None
            elif m:
                fence = m[1]
                sizes["fenced_code"] += len(line)
            elif line.lstrip().startswith(">"):
                sizes["blockquote"] += len(line)
            else:
                inline = sum(len(x) for x in re.findall(r"`[^`\n]+`", line))
                sizes["inline_code"] += inline
                sizes["prose"] += len(line) - inline
        rows.append(tuple(sizes.values()))
    return pd.DataFrame(rows, columns=["prose", "fenced_code", "blockquote", "inline_code"])


def _rows_as_csv(text: str) -> str | None:
    try:
        rows = json.loads(text)
    except ValueError:
        return None
    if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) and r.keys() == rows[0].keys() for r in rows):
        return None
    names = list(rows[0])
    if any(isinstance(v, (dict, list)) for r in rows for v in r.values()):
        return None
    cell = lambda v: json.dumps(v, ensure_ascii=False)
    return "\n".join([",".join(cell(n) for n in names), *(",".join(cell(r[n]) for n in names) for r in rows)])


@F.pandas_udf(T.StringType())
def lossless_csv(texts: pd.Series) -> pd.Series:
    """A JSON array of uniform flat rows as CSV whose cells are JSON, null for anything else."""
    return texts.map(_rows_as_csv, na_action="ignore")


#: Rows under which an array is left alone; rows that a shortened one keeps, of them at the head; the saving from which CSV is preferred.
LEAST_ROWS, KEPT_ROWS, HEAD_ROWS, CSV_SAVES = 5, 15, 9, 0.15


def _array_view(text: str) -> tuple[str, int, int, str | None]:
    """(form, rows, kept, view) of a JSON array of objects; form is none where the text is no such array or too short."""
    try:
        rows = json.loads(text)
    except ValueError:
        rows = None
    if not isinstance(rows, list) or len(rows) < LEAST_ROWS or not all(isinstance(r, dict) for r in rows):
        return "none", 0, 0, None
    apart = list({json.dumps(r, ensure_ascii=False, sort_keys=True): r for r in reversed(rows)}.values())[::-1]
    table = _rows_as_csv(text) if len(apart) == len(rows) else None
    if table is not None and len(table.encode()) <= (1 - CSV_SAVES) * len(text.encode()):
        return "csv", len(rows), len(rows), table
    keep = set(range(len(apart)))
    if len(apart) > KEPT_ROWS:
        tail = min(-(-len(apart) * 15 // 100), KEPT_ROWS - HEAD_ROWS)
        keep = {*range(min(HEAD_ROWS, -(-len(apart) * 3 // 10))), *range(len(apart) - tail, len(apart))}
        turns = [i for i in range(1, len(apart)) if apart[i].keys() != apart[i - 1].keys() and i not in keep]  # where the fields change
        keep |= set(turns[: KEPT_ROWS - len(keep)])
    body = [apart[i] for i in sorted(keep)]
    if len(body) < len(rows):
        body.append({"_omitted": len(rows) - len(body)})
    return "array", len(rows), len(keep), json.dumps(body, ensure_ascii=False)


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("rows_total", T.IntegerType()), T.StructField("rows_kept", T.IntegerType()), T.StructField("view", T.StringType())]))
def array_view(texts: pd.Series) -> pd.DataFrame:
    """A JSON array of objects in fewer characters: repeated rows once; as CSV if no row repeats and that saves enough, else the
    head, the tail and the rows where the fields change, with a note of how many are left out."""
    return pd.DataFrame([_array_view(t) if t is not None else ("none", 0, 0, None) for t in texts], columns=["form", "rows_total", "rows_kept", "view"]).astype({"view": object})


# Keys whose value is a secret, without hyphens, underscores and blanks, lower case.
SECRET_KEYS = frozenset({"apikey", "secret", "password", "passwd", "token", "accesstoken"})
_RULES = [(re.compile(pattern), by.replace("$1", r"\1")) for _, pattern, by in SECRET_RULES]


def _redacted(value, count: list[int]):
    if isinstance(value, dict):
        out = {}
        for key, inner in value.items():
            named = re.sub(r"[-_\s]", "", key).lower() in SECRET_KEYS
            count[0] += named
            out[key] = "[REDACTED]" if named else _redacted(inner, count)
        return out
    if isinstance(value, list):
        return [_redacted(x, count) for x in value]
    if isinstance(value, str):
        for pattern, by in _RULES:
            value, n = pattern.subn(by, value)
            count[0] += n
    return value


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("redactions", T.IntegerType())]))
def redacted_json(texts: pd.Series) -> pd.DataFrame:
    """JSON with the values of secret keys and the secrets inside texts, at any depth, replaced; null for what is no JSON."""
    rows = []
    for text in texts:
        try:
            value, count = json.loads(text), [0]
            rows.append((json.dumps(_redacted(value, count), ensure_ascii=False), count[0]))
        except (TypeError, ValueError):
            rows.append((None, 0))
    return pd.DataFrame(rows, columns=["text", "redactions"]).astype({"text": object})
