"""Three-valued temporal queries over the facts' valid times (t.., v12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import temporal as T
from tracelake.operators import lineage as L
from tracelake.registry import query
from tracelake.sources.tables import SQL_MEMORIES, memories

NOW = "2024-02-01 00:00:00"


def _now():
    return T.instant(F.lit(NOW).cast("timestamp_ntz"))


def _facts(spark, d):
    rows = memories(spark, d)
    start, end = T.envelope(F.col("valid_from"), F.col("valid_from_precision")), T.envelope(F.col("valid_to"), F.col("valid_to_precision"))
    return rows.withColumn("start", start).withColumn("end", end)


def _sql_env(bound: str, name: str) -> str:
    known = f"{bound} IS NOT NULL AND {bound}_precision IN ('day', 'month', 'year', 'instant')"
    return (
        f"CASE WHEN {known} THEN CASE {bound}_precision WHEN 'instant' THEN {bound} WHEN 'day' THEN date_trunc('day', {bound}) WHEN 'month' THEN date_trunc('month', {bound}) ELSE date_trunc('year', {bound}) END END AS {name}_lo, "
        f"CASE WHEN {known} THEN CASE {bound}_precision WHEN 'instant' THEN {bound} WHEN 'day' THEN date_trunc('day', {bound}) + INTERVAL 1 DAY WHEN 'month' THEN date_trunc('month', {bound}) + INTERVAL 1 MONTH ELSE date_trunc('year', {bound}) + INTERVAL 1 YEAR END END AS {name}_hi, "
        f"coalesce({bound} IS NOT NULL AND {bound}_precision = 'instant', false) AS {name}_one"
    )


def _sql_lt(a: str, b: str) -> str:
    """lt3 of two envelopes with columns a_lo, a_hi, a_one."""
    sure = f"CASE WHEN {a}_one THEN {a}_lo < {b}_lo ELSE {a}_hi <= {b}_lo END"
    able = f"CASE WHEN {a}_one AND {b}_one THEN {a}_lo < {b}_lo WHEN {b}_one THEN coalesce({a}_lo < {b}_lo, true) ELSE coalesce({a}_lo < {b}_hi, true) END"
    return f"(CASE WHEN coalesce({sure}, false) THEN true WHEN NOT ({able}) THEN false END)"


def _sql_le(a: str, b: str) -> str:
    return f"(NOT {_sql_lt(b, a)})"


_FACTS = f"WITH {SQL_MEMORIES}, f AS (SELECT *, {_sql_env('valid_from', 's')}, {_sql_env('valid_to', 'e')}, TIMESTAMP '{NOW}' AS n_lo, TIMESTAMP '{NOW}' AS n_hi, true AS n_one FROM mem) "
_STATUS = (
    f"CASE WHEN {_sql_le('s', 'n')} AND {_sql_lt('n', 'e')} THEN 'current' WHEN {_sql_lt('n', 's')} THEN 'not_yet_valid' "
    f"WHEN NOT (e_lo IS NULL AND e_hi IS NULL) AND {_sql_le('e', 'n')} THEN 'expired' WHEN {_sql_le('s', 'n')} AND e_lo IS NULL AND e_hi IS NULL THEN 'current_open' ELSE 'unknown' END"
)


@query("t01_three_valued", "WITH v(a) AS (SELECT CASE WHEN confidence >= 0.8 THEN true WHEN confidence < 0.4 THEN false END FROM candidates) SELECT CAST(a AS VARCHAR) AS a, CAST(a AND NULL AS VARCHAR) AS a_and_unknown, CAST(a OR NULL AS VARCHAR) AS a_or_unknown, CAST(NOT a AS VARCHAR) AS not_a, count(*) AS n FROM v GROUP BY 1, 2, 3, 4")
def t01(spark, d):
    a = F.when(F.col("confidence") >= 0.8, True).when(F.col("confidence") < 0.4, False)
    unknown = F.lit(None).cast("boolean")
    rows = spark.read.parquet(f"{d}/candidates.parquet").select(a.alias("a"))
    rows = rows.select(F.col("a").cast("string").alias("a"), (F.col("a") & unknown).cast("string").alias("a_and_unknown"), (F.col("a") | unknown).cast("string").alias("a_or_unknown"), (~F.col("a")).cast("string").alias("not_a"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("t02_before_now", _FACTS + f"SELECT id, {_sql_lt('s', 'n')} AS starts_before, {_sql_lt('e', 'n')} AS ends_before FROM f")
def t02(spark, d):
    return _facts(spark, d).select("id", T.lt3(F.col("start"), _now()).alias("starts_before"), T.lt3(F.col("end"), _now()).alias("ends_before"))


@query("t03_not_after", _FACTS + f"SELECT id, {_sql_le('s', 'e')} AS in_order FROM f")
def t03(spark, d):
    return _facts(spark, d).select("id", T.le3(F.col("start"), F.col("end")).alias("in_order"))


@query("t04_holds_now", _FACTS + f"SELECT id, {_sql_le('s', 'n')} AND {_sql_lt('n', 'e')} AS holds FROM f")
def t04(spark, d):
    return _facts(spark, d).select("id", T.contains3(F.col("start"), F.col("end"), _now()).alias("holds"))


@query("t05_validity_status", _FACTS + f"SELECT id, {_STATUS} AS status FROM f")
def t05(spark, d):
    return _facts(spark, d).select("id", T.validity_status(F.col("start"), F.col("end"), _now()).alias("status"))


_CHAINED = ", nx AS (SELECT f.*, x.id AS next_id, x.s_lo AS x_lo, x.s_hi AS x_hi FROM f LEFT JOIN f x ON x.supersedes_id = f.id) "


@query("t06_effective_end", _FACTS + _CHAINED + "SELECT id, epoch_us(CASE WHEN e_lo IS NULL AND e_hi IS NULL THEN x_lo ELSE e_lo END) AS end_lo_us, next_id FROM nx")
def t06(spark, d):
    """The end of each fact, closed by the start of the fact that supersedes it."""
    facts = _facts(spark, d)
    after = facts.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), F.col("id").alias("next_id"), F.col("start").alias("next_start"))
    end = T.effective_end(F.col("end"), F.col("next_start"))
    return facts.join(after, "id", "left").withColumn("e", end).select("id", F.expr("unix_micros(cast(e.lo as timestamp))").alias("end_lo_us"), "next_id")


_VERSIONS = ", vs AS (SELECT example_id, content, s_lo, s_hi, s_one, e_lo, e_hi, e_one, min(id) AS id FROM f WHERE content IS NOT NULL GROUP BY ALL) "


@query(
    "t07_possible_conflicts",
    _FACTS + _VERSIONS + f"SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM vs a JOIN vs b ON a.example_id = b.example_id AND a.id < b.id AND a.content <> b.content WHERE ({_sql_lt('a.s', 'b.e')} AND {_sql_lt('b.s', 'a.e')}) IS DISTINCT FROM false",
)
def t07(spark, d):
    """All pairs of an example's versions that differ and may hold at the same time; versions of one content and validity are one,
    named by the smallest id, so that repetition multiplies nothing."""
    rows = _facts(spark, d).where("content is not null").groupBy("example_id", "content", "start", "end").agg(F.min("id").alias("id"))
    other = rows.select("example_id", *[F.col(c).alias(f"{c}_b") for c in ("id", "content", "start", "end")])
    clash = T.overlaps3((F.col("start"), F.col("end")), (F.col("start_b"), F.col("end_b")))
    both = rows.join(other, "example_id").where("id < id_b and content <> content_b").where(~clash.eqNullSafe(F.lit(False)))
    return both.select(F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b"))


@query("t09_envelopes", _FACTS + "SELECT id, epoch_us(s_lo) AS lo_us, epoch_us(s_hi) AS hi_us, s_one AS singleton FROM f")
def t09(spark, d):
    rows = _facts(spark, d)
    return rows.select("id", F.expr("unix_micros(cast(start.lo as timestamp))").alias("lo_us"), F.expr("unix_micros(cast(start.hi as timestamp))").alias("hi_us"), F.col("start.singleton").alias("singleton"))


@query("t10_interval_errors", _FACTS + f"SELECT id, CASE WHEN {_sql_lt('e', 's')} THEN 'inverted' WHEN s_one AND e_one AND s_lo = e_lo THEN 'empty' END AS error FROM f")
def t10(spark, d):
    return _facts(spark, d).select("id", T.interval_error(F.col("start"), F.col("end")).alias("error"))


@query("t12_coarse_age", "SELECT id, CASE WHEN s < 60 THEN 'under a minute' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM (SELECT DISTINCT id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(created_at)) / 1000000.0) AS BIGINT) AS s FROM finalization_quarantine)")
def t12(spark, d):
    seconds = F.floor((F.expr("unix_micros(timestamp'2024-01-31 00:00:00Z')") - F.expr("unix_micros(cast(created_at as timestamp))")) / 1000000.0)
    rows = spark.read.parquet(f"{d}/finalization_quarantine.parquet").select("id", seconds.alias("s")).distinct()
    return rows.select("id", T.coarse_age(F.col("s")).alias("age"))


@query("v12_current_memories", _FACTS + f", st AS (SELECT *, {_STATUS} AS status FROM f) SELECT id, status, epoch_us(created_at) AS created_us FROM st WHERE id NOT IN (SELECT supersedes_id FROM f WHERE supersedes_id IS NOT NULL) AND status IN ('current', 'current_open', 'unknown')")
def v12(spark, d):
    """Latest versions that hold now, or may: what an expired or future bound rules out is gone."""
    facts = _facts(spark, d)
    status = T.validity_status(F.col("start"), F.col("end"), _now())
    rows = L.without_superseded(facts).withColumn("status", status).where(F.col("status").isin("current", "current_open", "unknown"))
    return rows.select("id", "status", F.expr("unix_micros(cast(created_at as timestamp))").alias("created_us"))
