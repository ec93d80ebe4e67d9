"""Stateful text operators, written times and chains (f10, f24, t08, t11, w11, i01)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracelake.functions import temporal as T
from tracelake.operators import chain, markup
from tracelake.registry import query
from tracelake.sources.tables import SQL_LOG, log, read


@query("f10_private_regions")
def f10(spark, d):
    """Quarantined records without the regions between finalization tags, which are read as private."""
    text = F.regexp_replace("raw_content", "finalize", "private")
    rows = read(spark, d, "finalization_quarantine").select("id", text.alias("text")).distinct()
    return rows.select("id", markup.without_private("text").alias("p")).select("id", "p.text", "p.regions")


@query("f24_markdown_zones")
def f24(spark, d):
    return read(spark, d, "documents").select("doc_id", markup.zone_sizes(F.coalesce("text", F.lit(""))).alias("z")).select("doc_id", "z.*")


# what was written of a fact's start: the expression, else its time to the precision that it is known to
_SQL_RAW = "SELECT DISTINCT id, coalesce(temporal_expression, CASE valid_from_precision WHEN 'year' THEN strftime(valid_from, '%Y') WHEN 'month' THEN strftime(valid_from, '%Y-%m') WHEN 'day' THEN strftime(valid_from, '%Y-%m-%d') ELSE strftime(valid_from, '%Y-%m-%dT%H:%M:%S.%fZ') END, '') AS raw, created_at FROM candidates"
_SQL_BOUND = rf"""b AS (SELECT id, trim(raw) AS raw, lower(trim(raw)) AS low, date_trunc('day', created_at) AS day, created_at FROM ({_SQL_RAW})),
p AS (SELECT *, CASE {' '.join(f"WHEN low = '{w}' THEN {n}" for w, n in T.DAY_WORDS)} END AS off, try_strptime(raw || CASE WHEN regexp_matches(raw, '^\d{{4}}$') THEN '-01-01' WHEN regexp_matches(raw, '^\d{{4}}-\d{{2}}$') THEN '-01' ELSE '' END, '%Y-%m-%d') AS start,
  regexp_matches(raw, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,6}})?)?(Z|[+-]\d{{2}}:\d{{2}})$') AS zoned, regexp_matches(raw, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,6}})?)?$') AS naive FROM b)"""


@query(
    "t08_normalized_bounds",
    rf"""WITH {_SQL_BOUND} SELECT id,
  CASE WHEN raw = '' THEN 'unknown' WHEN off IS NOT NULL THEN 'day' WHEN start IS NOT NULL AND len(raw) = 4 THEN 'year' WHEN start IS NOT NULL AND len(raw) = 7 THEN 'month' WHEN start IS NOT NULL AND len(raw) = 10 THEN 'day' WHEN zoned THEN 'instant' END AS precision,
  CASE WHEN raw = '' OR off IS NOT NULL OR start IS NOT NULL OR zoned THEN NULL WHEN regexp_matches(raw, '^\d{{4}}(-\d{{2}}){{0,2}}$') THEN 'invalid_calendar_value' WHEN naive THEN 'naive_timestamp' ELSE 'unparseable_temporal' END AS error,
  epoch_us(CASE WHEN raw = '' THEN NULL WHEN off IS NOT NULL THEN day + off * INTERVAL 1 DAY WHEN start IS NOT NULL THEN start WHEN zoned THEN CAST(raw AS TIMESTAMP) END) AS lo_us FROM p""",
)
def t08(spark, d):
    """What the written start of each fact stands for, or why it stands for nothing; relative days are anchored at the fact's record."""
    at = F.coalesce(*[F.when(F.col("valid_from_precision") == p, F.date_format("valid_from", f)) for p, f in (("year", "yyyy"), ("month", "yyyy-MM"), ("day", "yyyy-MM-dd"))], F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(""))
    rows = read(spark, d, "candidates").select("id", F.coalesce("temporal_expression", at).alias("raw"), "created_at").distinct()
    return rows.select("id", T.parsed_bound(F.col("raw"), F.col("created_at")).alias("b")).select("id", "b.precision", "b.error", F.unix_micros(F.col("b.lo").cast("timestamp")).alias("lo_us"))


def _sql_windows() -> str:
    said, cases = lambda p: f"regexp_extract(content, '{T.whole_words(p)}', 2)", []
    for words, back, until in T.AGO:
        cases.append((f"{said(words)} <> ''", f"day - INTERVAL {back} DAY", f"day - INTERVAL {until} DAY", said(words)))
    for word, n in T.DAY_WORDS:
        cases.append((f"{said(word)} <> ''", f"day + INTERVAL ({n}) DAY", f"day + INTERVAL ({n + 1}) DAY", f"'{word}'"))
    last = said("|".join(words for words, _ in T.LAST))
    for words, unit in T.LAST:
        cases.append((f"regexp_matches({last}, '(?i)^(?:{words})$')", f"date_trunc('{unit}', created_at) - INTERVAL 1 {unit}", f"date_trunc('{unit}', created_at)", last))
    cases.append(("first IS NOT NULL", "first", "first + INTERVAL 1 MONTH", f"regexp_extract(content, '{T.MONTH}', 2)"))
    cases.insert(0, ("iso IS NOT NULL", "iso", "iso + INTERVAL 1 DAY", said(r"\d{4}-\d{2}-\d{2}")))
    part = lambda *n: " || ".join(f"regexp_extract(content, '{T.MONTH}', {k})" for k in n)
    number = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(w) for w in names.split())}) THEN {n}" for n, names in enumerate(T.MONTH_NAMES, 1)) + " END"
    column = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[k]}" for c in cases) + " END"
    return f"""{SQL_LOG}, q0 AS (SELECT id, content, created_at, date_trunc('day', created_at) AS day, try_strptime({said(r"\d{4}-\d{2}-\d{2}")}, '%Y-%m-%d') AS iso, lower({part(3, 5)}) AS name, {part(4, 6)} AS y FROM (SELECT id, kind, lower(content) AS content, created_at FROM log) WHERE kind = 'message' AND content IS NOT NULL),
q1 AS (SELECT *, {number} AS m FROM q0), q2 AS (SELECT *, CASE WHEN m IS NOT NULL THEN try_strptime((CASE WHEN y <> '' THEN y ELSE CAST(year(created_at) - CASE WHEN m > month(created_at) THEN 1 ELSE 0 END AS VARCHAR) END) || '-' || m, '%Y-%m') END AS first FROM q1),
qw AS (SELECT id, {column(3)} AS expression, CAST({column(1)} AS TIMESTAMP) AS start, CAST({column(2)} AS TIMESTAMP) AS until FROM q2)"""


_SQL_WINDOWS = _sql_windows()


@query("t11_query_windows", f"WITH {_SQL_WINDOWS} SELECT id, expression, epoch_us(start) AS start_us, epoch_us(until) AS end_us FROM qw WHERE start IS NOT NULL")
def t11(spark, d):
    """Messages that name a window of time, with its bounds; what is relative is relative to the message."""
    rows = log(spark, d, "kind = 'message' and content is not null")
    rows = rows.select("id", T.query_window(F.col("content"), F.col("created_at")).alias("w")).where("w is not null")
    return rows.select("id", "w.expression", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("w.end").cast("timestamp")).alias("end_us"))


@query("w11_context_around_hits", f"WITH {SQL_LOG}, g AS (SELECT DISTINCT session_id, seq // 20 AS grp FROM log WHERE session_id IS NOT NULL), h AS (SELECT DISTINCT session_id, seq // 20 AS grp FROM log WHERE session_id IS NOT NULL AND contains(lower(content), 'retrieval order')) SELECT DISTINCT g.session_id, g.grp FROM g JOIN h ON h.session_id = g.session_id AND g.grp BETWEEN h.grp - 1 AND h.grp + 1")
def w11(spark, d):
    """The groups around each hit: neighbours are generated and looked up, instead of a range join."""
    rows = log(spark, d, "session_id is not null").select("session_id", F.expr("seq div 20").alias("grp"), F.coalesce(F.contains(F.lower("content"), F.lit("retrieval order")), F.lit(False)).alias("hit"))
    groups = rows.groupBy("session_id", "grp").agg(F.max("hit").alias("hit"))
    near = groups.where("hit").select("session_id", F.explode(F.sequence(F.col("grp") - 1, F.col("grp") + 1)).alias("grp")).distinct()
    return groups.join(near, ["session_id", "grp"], "left_semi").select("session_id", "grp")


@query("i01_built_chains")
def i01(spark, d):
    """A chain per branch, folded in pieces of a thousand positions, and each piece's digest."""
    return chain.build(log(spark, d), "branch_id")


@query("j08_changes_since", f"WITH {SQL_LOG}, c AS (SELECT unnest(files) AS file, seq FROM log WHERE kind = 'tool_output'), b AS (SELECT file, min(seq) AS baseline, count(*) AS n FROM c GROUP BY 1) SELECT file, baseline, n - 1 AS changes, n - 1 >= 3 AS over_threshold FROM b")
def j08(spark, d):
    """Changes of each file after its first: a count per file, since the baseline is the file's own first change."""
    rows = log(spark, d, "kind = 'tool_output'").select(F.explode("files").alias("file"), "seq")
    n = F.count(F.lit(1))
    return rows.groupBy("file").agg(F.min("seq").alias("baseline"), (n - 1).alias("changes"), (n - 1 >= 3).alias("over_threshold"))


@query("j24_file_overlaps", f"WITH {SQL_LOG}, t AS (SELECT unnest(files) AS file, session_id FROM log WHERE session_id IS NOT NULL) SELECT file, count(DISTINCT session_id) AS sessions FROM t GROUP BY 1 HAVING count(DISTINCT session_id) > 1")
def j24(spark, d):
    """Files that more than one session touched."""
    rows = log(spark, d, "session_id is not null").select(F.explode("files").alias("file"), "session_id")
    return rows.groupBy("file").agg(F.count_distinct("session_id").alias("sessions")).where("sessions > 1")


# Names under which a usage record gives its tokens, and where it may lie in a reply, the inmost first.
ALIASES = {"input_tokens": ("input_tokens", "prompt_tokens", "inputTokens"), "output_tokens": ("output_tokens", "completion_tokens", "outputTokens")}
PLACES = ("$.metadata.usage", "$.metadata", "$.response.usage", "$.response", "$.token_usage.usage", "$.token_usage", "$.usage.usage", "$.usage", "$")


def usage_value(reply: Column, measure: str) -> Column:
    """The first value that a reply in JSON gives of a measure, by place and then by name."""
    return F.coalesce(*[F.get_json_object(reply, f"{place}.{name}") for place in PLACES for name in ALIASES[measure]])


# replies as the adapters' models write them, with the size of each event in one of the notations
_SQL_REPLY = """CASE origin_channel WHEN 'hook' THEN '{"usage":{"prompt_tokens":' || size || ',"completion_tokens":' || seq || '}}' WHEN 'host' THEN '{"inputTokens":1,"response":{"usage":{"inputTokens":' || size || '},"outputTokens":' || seq || '}}' ELSE '{"input_tokens":' || size || ',"metadata":{"usage":{"output_tokens":null}}}' END"""


@query("f37_usage_aliases", f"WITH {SQL_LOG}, r AS (SELECT id, {_SQL_REPLY} AS reply FROM (SELECT *, coalesce(strlen(content), 0) AS size FROM log)) SELECT id, " + ", ".join(f"CAST(coalesce({', '.join(f"json_extract_string(reply, '{p}.{n}')" for p in PLACES for n in ALIASES[m])}) AS BIGINT) AS {m}" for m in ALIASES) + " FROM r")
def f37(spark, d):
    """The tokens that replies in several notations give, among all names and places."""
    rows = log(spark, d).withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0))).select("id", F.expr(_SQL_REPLY).alias("reply"))
    return rows.select("id", *[usage_value(F.col("reply"), m).cast("bigint").alias(m) for m in ALIASES])


@query("f43_tool_receipts", f"WITH {SQL_LOG} SELECT id, sha256(concat_ws(chr(31), coalesce(session_id, ''), kind, json_extract_string(payload_json, '$.call_id'))) AS receipt, len(files) AS n_files FROM log WHERE json_extract_string(payload_json, '$.call_id') IS NOT NULL")
def f43(spark, d):
    call = F.get_json_object("payload_json", "$.call_id")
    rows = log(spark, d, call.isNotNull())
    return rows.select("id", F.sha2(F.concat_ws("\x1f", F.coalesce("session_id", F.lit("")), "kind", call), 256).alias("receipt"), F.size("files").alias("n_files"))


# Patterns of commands that a pre-check stops.
STOPPED = (("removes", r"\brm\s+-rf?\b"), ("forces", r"--force\b"), ("secret", r"(?i)\b(?:password|token|secret)\s*="))


@query("f40_command_rules", f"WITH {SQL_LOG}, r(name, pattern) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in STOPPED) + ") SELECT id, name FROM log, r WHERE regexp_matches(content, pattern)")
def f40(spark, d):
    """Events with each rule that their text breaks; the rules stand in the plan as constants."""
    broken = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), n) for n, p in STOPPED]))
    return log(spark, d).select("id", F.explode(broken).alias("name"))
