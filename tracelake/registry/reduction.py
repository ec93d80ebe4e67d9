"""Views of tool outputs and what they keep (g02-g08, a16, f41)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions import views as V
from tracelake.operators import markup
from tracelake.registry import query
from tracelake.registry.analytics import _SQL_TOKENS
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, log, memories


def _hit(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def _near(rows: str, *patterns: str) -> str:
    return f"list_filter({rows}, lambda x, i: len(list_filter({rows}[greatest(i - {V.RADIUS}, 1):i + {V.RADIUS}], lambda y: {_hit('y', *patterns)})) > 0)"


def _once(rows: str) -> str:
    return f"list_filter({rows}, lambda x, i: list_position({rows}, x) = i)"


_BLANK = r"^\s+|\s+$"
_SQL_LINES = SQL_LOG + rf""", ln AS (SELECT id, seq, origin_adapter, json_extract_string(payload_json, '$.call_id') AS call_id, content, {_SQL_TOKENS} AS raw,
  list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(content, '{X.TERMINAL_ESCAPE}', '', 'g'), '\r\n?', chr(10), 'g'), '{_BLANK}', '', 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS l FROM log WHERE kind = 'tool_output' AND content IS NOT NULL)"""
_SQL_TEST = f"tp AS (SELECT *, {_near('l', X.FAILURE)} || (list_filter(l, lambda x: {_hit('x', X.WARNING)}))[-{V.WARNINGS}:] || list_filter(l, lambda x: {_hit('x', X.SUMMARY)}) AS parts FROM ln), tv AS (SELECT *, CASE WHEN len(parts) > 0 THEN {_once('parts')} ELSE l[-{V.TAIL}:] END AS view FROM tp)"
_SQL_SEARCH = f"sp AS (SELECT *, list_transform(flatten(list_transform(l, lambda x: regexp_extract_all(x, '{X.PATH_LINE}', 0))), lambda x: trim(x)) AS places FROM ln), sv AS (SELECT *, {_once('places')} || list_filter(l, lambda x: NOT {_hit('x', X.PATH_LINE)} AND {_hit('x', X.FAILURE, X.WARNING)}) AS view FROM sp)"
_SQL_BUILD = f"bp AS (SELECT *, {_near('l', X.FAILURE, X.WARNING)} AS near, list_filter(l[-{V.TAIL}:], lambda x: NOT list_contains({_near('l', X.FAILURE, X.WARNING)}, x)) AS rest FROM ln), bv AS (SELECT *, near || {_once('rest')} AS view FROM bp)"
_SQL_GENERIC = f"""gs AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]) AS starts FROM ln),
gc AS (SELECT *, flatten(list_transform(starts, lambda i, k: CASE WHEN coalesce(starts[k + 1], len(l) + 1) - i > 1 THEN [l[i], '[previous line repeated ' || (coalesce(starts[k + 1], len(l) + 1) - i - 1) || ' more times]'] ELSE [l[i]] END)) AS c FROM gs),
gn AS (SELECT *, {_near('c', X.FAILURE, X.WARNING)} AS near FROM gc),
gh AS (SELECT *, c[1:{V.HEAD}] || ['[... ' || (len(c) - {V.HEAD + V.TAIL}) || ' middle lines omitted ...]'] AS head FROM gn),
gr AS (SELECT *, list_filter(near, lambda x: NOT list_contains(head, x)) AS rest FROM gh),
gv AS (SELECT *, CASE WHEN len(c) <= {V.HEAD + V.TAIL} THEN c ELSE head || {_once('rest')} || c[-{V.TAIL}:] END AS view FROM gr)"""
_SQL_SHOWN = "SELECT id, len(l) AS raw_lines, len(view) AS kept_lines, md5(array_to_string(view, chr(10))) AS digest FROM "


def outputs(spark, d):
    """(id, seq, origin_adapter, call_id, content, raw, l): tool outputs with their tokens and lines."""
    rows = log(spark, d, "kind = 'tool_output' and content is not null")
    return rows.select("id", "seq", "origin_adapter", F.get_json_object("payload_json", "$.call_id").alias("call_id"), "content", X.token_estimate(F.col("content")).alias("raw"), V.lines(F.col("content")).alias("l"))


def _shown(rows, view):
    return rows.select("id", "l", view.alias("view")).select("id", F.size("l").alias("raw_lines"), F.size("view").alias("kept_lines"), F.md5(F.array_join("view", "\n")).alias("digest"))


@query("g02_test_view", f"WITH {_SQL_LINES}, {_SQL_TEST} {_SQL_SHOWN} tv")
def g02(spark, d):
    return _shown(outputs(spark, d), V.test_view(F.col("l")))


@query("g03_search_view", f"WITH {_SQL_LINES}, {_SQL_SEARCH} {_SQL_SHOWN} sv")
def g03(spark, d):
    return _shown(outputs(spark, d), V.search_view(F.col("l")))


@query("g04_build_view", f"WITH {_SQL_LINES}, {_SQL_BUILD} {_SQL_SHOWN} bv")
def g04(spark, d):
    return _shown(outputs(spark, d), V.build_view(F.col("l")))


@query("g05_generic_view", f"WITH {_SQL_LINES}, {_SQL_GENERIC} {_SQL_SHOWN} gv")
def g05(spark, d):
    return _shown(outputs(spark, d).withColumn("c", V.collapsed(F.col("l"))), V.generic_view(F.col("c")))


#: Lines that no view may lose: the counts of test runs.
PROTECTED = X.SUMMARY

_SQL_KEPT = f"pl AS (SELECT *, list_filter(l, lambda x: {_hit('x', PROTECTED)} AND NOT list_contains(view, x)) AS lost, list_filter(l, lambda x: {_hit('x', PROTECTED)}) AS required FROM bv)"


@query("g07_protected_lines", f"WITH {_SQL_LINES}, {_SQL_BUILD}, {_SQL_KEPT} SELECT id, len(required) AS required, len(lost) AS lost, md5(array_to_string(CASE WHEN len(lost) > 0 THEN view || ['[protected lines]'] || lost ELSE view END, chr(10))) AS digest FROM pl")
def g07(spark, d):
    """Build views with the protected lines that they lack; none of them is lost in the end."""
    rows = outputs(spark, d).withColumn("view", V.build_view(F.col("l"))).withColumn("required", F.filter("l", lambda x: x.rlike(PROTECTED)))
    lost = F.size(F.filter("required", lambda x: ~F.array_contains("view", x)))
    return rows.select("id", F.size("required").alias("required"), lost.alias("lost"), F.md5(F.array_join(V.protected(F.col("view"), F.col("l"), PROTECTED), "\n")).alias("digest"))


_SQL_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(tool), '{'|'.join(w)}') THEN '{n}'" for n, w in X.FAMILIES) + " ELSE 'generic' END"
_SQL_FRAME = "'[view of ' || id || ', ' || raw || ' tokens]' || chr(10) || array_to_string(view, chr(10))"
# outputs by the family of their call, with the view of the family and what it keeps
_SQL_REDUCED = f"""{_SQL_LINES}, {_SQL_TEST}, {_SQL_SEARCH}, {_SQL_BUILD}, {_SQL_GENERIC},
tools AS (SELECT json_extract_string(payload_json, '$.call_id') AS call_id, max(content) AS tool FROM log WHERE kind = 'tool_call' AND json_extract_string(payload_json, '$.call_id') IS NOT NULL GROUP BY 1),
fam AS (SELECT ln.id, coalesce({_SQL_FAMILY}, 'generic') AS family FROM ln LEFT JOIN tools USING (call_id)),
vw AS (SELECT ln.*, fam.family, CASE fam.family WHEN 'test' THEN tv.view WHEN 'search' THEN sv.view WHEN 'build' THEN bv.view ELSE gv.view END AS view FROM ln JOIN fam USING (id) JOIN tv USING (id) JOIN sv USING (id) JOIN bv USING (id) JOIN gv USING (id)),
fr AS (SELECT id, origin_adapter, family, raw, l, view, {_SQL_TOKENS.replace('content', 'framed')} AS shown FROM (SELECT *, {_SQL_FRAME} AS framed FROM vw)),
rd AS (SELECT *, raw >= {V.LEAST_TOKENS} AND family NOT IN {V.WHOLE} AND shown < raw AS reduced FROM fr)"""


def reduced(spark, d):
    """Tool outputs by the family of their call: (id, origin_adapter, family, raw, l, view, shown, reduced).

    An output keeps its text where it is short, of a family that is never shortened, or where the framed view has no fewer tokens.
    """
    calls = log(spark, d, F.col("kind") == "tool_call").select(F.get_json_object("payload_json", "$.call_id").alias("call_id"), "content").where("call_id is not null").groupBy("call_id").agg(F.max("content").alias("tool"))
    rows = outputs(spark, d).join(calls, "call_id", "left").withColumn("family", F.coalesce(X.family(F.col("tool")), F.lit("generic"))).withColumn("c", V.collapsed(F.col("l")))
    own = F.col("l")
    view = F.when(F.col("family") == "test", V.test_view(own)).when(F.col("family") == "search", V.search_view(own)).when(F.col("family") == "build", V.build_view(own)).otherwise(V.generic_view(F.col("c")))
    rows = rows.withColumn("view", view)
    shown = X.token_estimate(V.framed(F.array_join("view", "\n"), F.col("id"), F.col("raw")))
    smaller = (F.col("raw") >= V.LEAST_TOKENS) & ~F.col("family").isin(*V.WHOLE) & (F.col("shown") < F.col("raw"))
    return rows.withColumn("shown", shown).withColumn("reduced", smaller)


@query("g08_reduction_savings", f"WITH {_SQL_REDUCED} SELECT origin_adapter, family, count(*) AS n, count(CASE WHEN reduced THEN 1 END) AS views, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(CASE WHEN reduced THEN shown ELSE raw END) AS BIGINT) AS emitted FROM rd GROUP BY 1, 2")
def g08(spark, d):
    """Tokens of the outputs and of what is shown of them, measured on the framed views."""
    emitted = F.when(F.col("reduced"), F.col("shown")).otherwise(F.col("raw"))
    return reduced(spark, d).groupBy("origin_adapter", "family").agg(F.count(F.lit(1)).alias("n"), F.count_if("reduced").alias("views"), F.sum("raw").alias("raw"), F.sum(emitted).alias("emitted"))


_SQL_SIGNALS = f"lambda x: {_hit('x', X.FAILURE, X.SUMMARY)}"
_SQL_PLAIN = r"list_distinct(list_filter(list_transform({0}, lambda x: trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'))), lambda x: x <> ''))"
_SQL_RECALL = f"rc AS (SELECT family, {_SQL_PLAIN.format('l')} AS a, {_SQL_PLAIN.format('view')} AS b FROM fr), rs AS (SELECT family, list_filter(a, {_SQL_SIGNALS}) AS sa, list_filter(b, {_SQL_SIGNALS}) AS sb, a, b FROM rc)"


@query("a16_retention", f"WITH {_SQL_REDUCED}, {_SQL_RECALL}, k AS (SELECT family, sum(len(sa)) AS s, sum(len(list_filter(sa, lambda x: list_contains(sb, x)))) AS sk, sum(len(a)) AS n, sum(len(list_filter(a, lambda x: list_contains(b, x)))) AS nk FROM rs GROUP BY 1) SELECT family, CAST(s AS BIGINT) AS signals, CAST(n AS BIGINT) AS lines, round(CASE WHEN s = 0 THEN 1.0 ELSE sk / s END, 6) AS signal_recall, round(CASE WHEN n = 0 THEN 1.0 ELSE nk / n END, 6) AS line_recall FROM k")
def a16(spark, d):
    """The share of critical lines and of all lines that the views keep, over all outputs of a family; 1 where there are none."""
    plain = lambda rows: F.array_distinct(F.filter(F.transform(rows, X.collapse), lambda x: x != ""))
    signal = lambda x: x.rlike(X.FAILURE) | x.rlike(X.SUMMARY)
    rows = reduced(spark, d).select("family", plain(F.col("l")).alias("a"), plain(F.col("view")).alias("b"))
    rows = rows.select("family", "a", "b", F.filter("a", signal).alias("sa"), F.filter("b", signal).alias("sb"))
    sums = rows.groupBy("family").agg(F.sum(F.size("sa")).alias("signals"), F.sum(F.size(F.array_intersect("sa", "sb"))).alias("sk"), F.sum(F.size("a")).alias("lines"), F.sum(F.size(F.array_intersect("a", "b"))).alias("nk"))
    share = lambda k, n: F.when(F.col(n) == 0, 1.0).otherwise(F.round(F.col(k) / F.col(n), 6))
    return sums.select("family", "signals", "lines", share("sk", "signals").alias("signal_recall"), share("nk", "lines").alias("line_recall"))


def _arrays(spark, d):
    """(run_id, rows): the facts of each extraction run as a JSON array of objects; nulls are no fields."""
    row = F.struct("ord", "id", F.col("memory_type").alias("type"), "content", "confidence")
    return memories(spark, d).groupBy("run_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("rows"))


@query("g06_array_views")
def g06(spark, d):
    """Each run's facts as a shorter view of their JSON array: repeated rows once, as CSV where that loses nothing and saves enough."""
    return _arrays(spark, d).select("run_id", "rows", markup.array_view("rows").alias("v")).select("run_id", F.length("rows").alias("raw_size"), "v.*")


@query("f41_lossless_csv")
def f41(spark, d):
    """Each run's facts as lossless CSV, null where they are not uniform."""
    return _arrays(spark, d).select("run_id", markup.lossless_csv("rows").alias("csv"))


# the facts without the log, which the views have already
_SQL_FACTS = "mem AS" + SQL_MEMORIES.split(", mem AS", 1)[1]
#: From so many views and such a share of them that a fact had to be taken from the whole output, a family is shortened too much.
LEAST_VIEWS, MOST_PROMOTED = 5, 0.2


@query("a07_overcompression", f"WITH {_SQL_REDUCED}, {_SQL_FACTS}, s AS (SELECT DISTINCT source_event_id AS id FROM mem), k AS (SELECT family, count(*) AS views, count(s.id) AS promoted FROM rd LEFT JOIN s USING (id) WHERE reduced GROUP BY 1) SELECT family, views, promoted, round(promoted / views, 4) AS ratio, views >= {LEAST_VIEWS} AND promoted / views > {MOST_PROMOTED} AS flagged FROM k")
def a07(spark, d):
    """How many of the shortened outputs of each family a fact refers to all the same."""
    sources = memories(spark, d).select(F.col("source_event_id").alias("id")).where("id is not null").distinct().withColumn("used", F.lit(True))
    per = reduced(spark, d).where("reduced").join(sources, "id", "left").groupBy("family").agg(F.count(F.lit(1)).alias("views"), F.count("used").alias("promoted"))
    share = F.col("promoted") / F.col("views")
    return per.select("family", "views", "promoted", F.round(share, 4).alias("ratio"), ((F.col("views") >= LEAST_VIEWS) & (share > MOST_PROMOTED)).alias("flagged"))


@query(
    "a17_policy_ratio",
    f"""WITH {_SQL_REDUCED}, ev AS (SELECT id, raw, list_filter({_SQL_PLAIN.format('l')}, {_SQL_SIGNALS}) AS need, {_SQL_PLAIN.format('l[1:5]')} AS head, {_SQL_PLAIN.format('view')} AS vw, shown FROM fr),
q AS (SELECT 'whole' AS policy, 1.0 AS quality, raw AS tokens FROM ev UNION ALL SELECT 'view', CASE WHEN len(need) = 0 THEN 1.0 ELSE len(list_filter(need, lambda x: list_contains(vw, x))) / len(need) END, shown FROM ev UNION ALL SELECT 'head', CASE WHEN len(need) = 0 THEN 1.0 ELSE len(list_filter(need, lambda x: list_contains(head, x))) / len(need) END, NULL FROM ev),
m AS (SELECT policy, avg(quality) AS quality, sum(tokens) AS tokens FROM q GROUP BY 1) SELECT policy, round(quality, 6) AS quality, CAST(tokens AS BIGINT) AS tokens, round(quality / (SELECT quality FROM m WHERE policy = 'whole'), 6) AS ratio FROM m""",
)
def a17(spark, d):
    """How much of the evidence in tool outputs each policy of showing them keeps, and against showing them whole; tokens of heads are not counted."""
    plain = lambda rows: F.array_distinct(F.filter(F.transform(rows, X.collapse), lambda x: x != ""))
    rows = reduced(spark, d).select("raw", "shown", F.filter(plain(F.col("l")), lambda x: x.rlike(X.FAILURE) | x.rlike(X.SUMMARY)).alias("need"), plain(F.slice("l", 1, 5)).alias("head"), plain(F.col("view")).alias("vw"))
    kept = lambda c: F.when(F.size("need") == 0, 1.0).otherwise(F.size(F.array_intersect("need", c)) / F.size("need"))
    policies = [(F.lit("whole"), F.lit(1.0), F.col("raw")), (F.lit("view"), kept("vw"), F.col("shown")), (F.lit("head"), kept("head"), F.lit(None).cast("bigint"))]
    each = rows.select(F.explode(F.array(*[F.struct(p.alias("policy"), q.alias("quality"), t.alias("tokens")) for p, q, t in policies])).alias("p"))
    means = each.groupBy("p.policy").agg(F.avg("p.quality").alias("quality"), F.sum("p.tokens").alias("tokens"))
    whole = F.broadcast(means.where("policy = 'whole'").select(F.col("quality").alias("base")))
    return means.crossJoin(whole).select("policy", F.round("quality", 6).alias("quality"), "tokens", F.round(F.col("quality") / F.col("base"), 6).alias("ratio"))
