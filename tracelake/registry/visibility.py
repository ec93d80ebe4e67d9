"""Scans, lineage visibility, versions and time travel (s.., v..)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import lineage as L
from tracelake.plans import ordered as O
from tracelake.registry import query
from tracelake.sources.tables import SQL_BRANCHES, SQL_LOG, SQL_MEMORIES, branches, log, memories, read

#: The instant up to which the time-travel queries look.
KNOWN_AT = "2024-01-15 00:00:00"

# the lineage of every branch that reaches a root or a missing id
SQL_LINES = (
    SQL_BRANCHES
    + """, walk(branch, ancestor, cutoff, distance) AS (
  SELECT node, node, CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM br
  UNION ALL
  SELECT w.branch, b.parent, least(w.cutoff, b.fork), w.distance + 1 FROM walk w JOIN br b ON b.node = w.ancestor WHERE b.parent IS NOT NULL AND w.distance <= (SELECT count(*) FROM br)),
lines AS (SELECT * FROM walk WHERE branch NOT IN (SELECT branch FROM walk WHERE distance > (SELECT count(*) FROM br)))"""
)
# the branch other than main with the most events
SQL_LEAF = "leaf AS (SELECT branch FROM (SELECT lower(trim(branch_id)) AS branch, count(*) AS n FROM log GROUP BY 1) WHERE branch <> 'main' ORDER BY n DESC, branch LIMIT 1)"
SQL_SEEN = f"WITH RECURSIVE {SQL_LOG}, {SQL_LINES}, {SQL_LEAF}, seen AS (SELECT e.* FROM log e JOIN lines l ON lower(trim(e.branch_id)) = l.ancestor WHERE l.branch IN (SELECT branch FROM leaf) AND (l.cutoff IS NULL OR e.seq <= l.cutoff)) "
SQL_MSEEN = f"WITH RECURSIVE {SQL_MEMORIES}, {SQL_LINES}, {SQL_LEAF}, known AS (SELECT coalesce(max(seq), 0) AS cutoff FROM log WHERE created_at <= TIMESTAMP '{KNOWN_AT}') "


def _leaf(events):
    counts = events.groupBy(F.lower(F.trim("branch_id")).alias("branch")).count().where("branch <> 'main'")
    return counts.orderBy(F.desc("count"), "branch").limit(1).select("branch")


def _seen(spark, d):
    events = log(spark, d)
    return L.visible(events, L.lineage(branches(spark, d), _leaf(events)))


@query("s01_point_lookup", f"WITH {SQL_LOG} SELECT seq, id, kind, role, content FROM log WHERE id = (SELECT min(id) FROM event_log)")
def s01(spark, d):
    first = read(spark, d, "event_log").agg(F.min("id").alias("id"))
    return log(spark, d).join(F.broadcast(first), "id", "left_semi").select("seq", "id", "kind", "role", "content")


@query("s02_query_events", SQL_SEEN + "SELECT seq, id, kind, content FROM (SELECT * FROM seen WHERE kind IN ('message', 'tool_output') AND contains(lower(content), 'the') ORDER BY seq DESC LIMIT 50)")
def s02(spark, d):
    """The last 50 events that a branch sees, of two kinds, with a text in them."""
    hits = _seen(spark, d).where(F.col("kind").isin("message", "tool_output") & F.contains(F.lower("content"), F.lit("the")))
    return hits.orderBy(F.desc("seq")).limit(50).select("seq", "id", "kind", "content").orderBy("seq")


@query("s03_events_by_operation", f"WITH {SQL_LOG} SELECT seq, id, kind FROM log WHERE json_extract_string(payload_json, '$.hook') = 'PostTool'")
def s03(spark, d):
    return log(spark, d, F.get_json_object("payload_json", "$.hook") == "PostTool").select("seq", "id", "kind")


@query("s04_completion_evidence", f"WITH {SQL_LOG} SELECT seq, id, content FROM log WHERE kind = 'tool_output' AND origin_channel = 'hook' AND seq > (SELECT max(seq) // 2 FROM event_log)")
def s04(spark, d):
    middle = read(spark, d, "event_log").agg(F.expr("max(seq) div 2").alias("middle"))
    rows = log(spark, d, "kind = 'tool_output' and origin_channel = 'hook'")
    return rows.join(F.broadcast(middle), F.col("seq") > F.col("middle")).select("seq", "id", "content")


@query("s05_list_memories", f"WITH {SQL_MEMORIES}, f AS (SELECT * FROM mem WHERE memory_type IN ('fact', 'preference') AND created_at >= TIMESTAMP '2024-01-05 00:00:00') SELECT id, memory_type, content FROM f WHERE id NOT IN (SELECT supersedes_id FROM f WHERE supersedes_id IS NOT NULL)")
def s05(spark, d):
    rows = memories(spark, d).where(F.col("memory_type").isin("fact", "preference") & (F.col("created_at") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    return L.without_superseded(rows).select("id", "memory_type", "content")


@query("s06_preceding_events", f"WITH {SQL_LOG}, said AS (SELECT * FROM log WHERE kind = 'message' AND role IN ('user', 'assistant')) SELECT id, lag(id, 1) OVER w AS before_1, lag(id, 2) OVER w AS before_2 FROM said WINDOW w AS (PARTITION BY branch_id ORDER BY seq)")
def s06(spark, d):
    """The two messages before each message of a branch, however far back."""
    said = log(spark, d, F.col("kind").eqNullSafe("message") & F.col("role").isin("user", "assistant")).select("id", "branch_id", "seq")
    one = O.with_previous(said, ["branch_id"], "seq", "id", "before_1")
    return O.with_previous(one, ["branch_id"], "seq", "before_1", "before_2").select("id", "before_1", "before_2")


@query("s07_timeline", SQL_SEEN + r"SELECT seq, id, kind, substr(trim(regexp_replace(content, '[\s\p{Z}]+', ' ', 'g')), 1, 160) AS preview FROM seen WHERE kind IN ('message', 'artifact')")
def s07(spark, d):
    return _seen(spark, d).where(F.col("kind").isin("message", "artifact")).select("seq", "id", "kind", text.preview(F.col("content")).alias("preview"))


@query("s11_gold_quotes", "SELECT id, q.memory_type AS memory_type, q.evidence_quote AS quote FROM (SELECT id, unnest(expected) AS q FROM extraction_examples)")
def s11(spark, d):
    return read(spark, d, "extraction_examples").select("id", F.explode("expected").alias("q")).select("id", "q.memory_type", F.col("q.evidence_quote").alias("quote"))


@query("s12_normalized_events", f"""WITH {SQL_LOG} SELECT id, CASE WHEN kind = 'message' AND role IN ('user', 'assistant', 'system') THEN role WHEN kind IN ('tool_call', 'tool_output') THEN 'tool' ELSE 'none' END AS speaker,
  CASE WHEN kind = 'tool_call' THEN 'call' WHEN kind = 'tool_output' THEN 'result' WHEN kind = 'message' THEN 'turn' ELSE 'record' END AS shape, json_extract_string(payload_json, '$.call_id') AS call_id FROM log""")
def s12(spark, d):
    speaker = F.when((F.col("kind") == "message") & F.col("role").isin("user", "assistant", "system"), F.col("role")).when(F.col("kind").isin("tool_call", "tool_output"), "tool").otherwise("none")
    shape = F.when(F.col("kind") == "tool_call", "call").when(F.col("kind") == "tool_output", "result").when(F.col("kind") == "message", "turn").otherwise("record")
    return log(spark, d).select("id", speaker.alias("speaker"), shape.alias("shape"), F.get_json_object("payload_json", "$.call_id").alias("call_id"))


@query("s13_hook_events", f"""WITH {SQL_LOG} SELECT id, 'event' AS part FROM log UNION ALL SELECT id, 'state' AS part FROM log WHERE json_extract_string(payload_json, '$.hook') = 'PostTool'""")
def s13(spark, d):
    """A delivery gives one event, a finished tool call a second one."""
    parts = F.when(F.get_json_object("payload_json", "$.hook") == "PostTool", F.array(F.lit("event"), F.lit("state"))).otherwise(F.array(F.lit("event")))
    return log(spark, d).select("id", F.explode(parts).alias("part"))


@query("s19_append_once", "SELECT sha256(concat(session_id, chr(31), kind, chr(31), content, chr(31), CAST(epoch_us(created_at) AS VARCHAR))) AS receipt, min(seq) AS seq, count(*) AS deliveries FROM event_log WHERE session_id IS NOT NULL AND content IS NOT NULL GROUP BY 1")
def s19(spark, d):
    """One row per receipt, at its first delivery."""
    at = F.expr("unix_micros(cast(created_at as timestamp))").cast("string")
    rows = read(spark, d, "event_log").where("session_id is not null and content is not null")
    rows = rows.select(F.sha2(F.concat_ws("\x1f", "session_id", "kind", "content", at), 256).alias("receipt"), "seq")
    return rows.groupBy("receipt").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("deliveries"))


@query("s21_unindexed", f"WITH {SQL_LOG} SELECT id FROM log WHERE id NOT IN (SELECT source_event_id FROM finalization_quarantine WHERE source_event_id IS NOT NULL) AND role = 'assistant'")
def s21(spark, d):
    """Assistant events that an index of quarantined sources does not hold yet."""
    done = read(spark, d, "finalization_quarantine").select(F.col("source_event_id").alias("id")).distinct()
    return log(spark, d, "role = 'assistant'").join(done, "id", "left_anti").select("id")


@query("v01_branch_lineage", f"WITH RECURSIVE {SQL_LINES} SELECT branch, ancestor, cutoff, distance FROM lines")
def v01(spark, d):
    return L.lineage(branches(spark, d))


@query("v02_visible_events", SQL_SEEN + "SELECT branch_id, kind, count(*) AS n, max(seq) AS last FROM seen GROUP BY 1, 2")
def v02(spark, d):
    return _seen(spark, d).groupBy("branch_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query("v03_fork_violations", f"""WITH RECURSIVE {SQL_LOG}, {SQL_LINES}, tips AS (
  SELECT l.branch, coalesce(max(e.seq), 0) AS tip FROM lines l LEFT JOIN log e ON lower(trim(e.branch_id)) = l.ancestor AND (l.cutoff IS NULL OR e.seq <= l.cutoff) WHERE l.branch IN (SELECT parent FROM br WHERE fork IS NOT NULL) GROUP BY 1)
SELECT b.node AS branch, b.parent, b.fork, t.tip FROM br b JOIN tips t ON t.branch = b.parent WHERE b.fork < 0 OR b.fork > t.tip""")
def v03(spark, d):
    tree = branches(spark, d)
    return L.fork_violations(tree, L.lineage(tree), log(spark, d))


@query("v04_known_at", f"SELECT coalesce(max(seq), 0) AS cutoff FROM event_log WHERE created_at <= TIMESTAMP '{KNOWN_AT}'")
def v04(spark, d):
    return L.known_at(read(spark, d, "event_log"), F.lit(KNOWN_AT).cast("timestamp_ntz"))


@query("v05_superseded_by_all", f"WITH {SQL_MEMORIES} SELECT id, memory_type FROM mem WHERE confidence >= 0.7 AND id NOT IN (SELECT supersedes_id FROM mem WHERE supersedes_id IS NOT NULL)")
def v05(spark, d):
    rows = memories(spark, d)
    return L.without_superseded(rows.where("confidence >= 0.7"), rows).select("id", "memory_type")


@query("v06_memories_as_of", SQL_MSEEN + "SELECT m.id, m.cursor_seq, m.supersedes_id FROM mem m JOIN lines l ON m.branch_id = l.ancestor, known WHERE l.branch IN (SELECT branch FROM leaf) AND m.cursor_seq <= least(l.cutoff, known.cutoff)")
def v06(spark, d):
    """All versions that a branch saw at an instant."""
    known = F.broadcast(L.known_at(log(spark, d), F.lit(KNOWN_AT).cast("timestamp_ntz")).withColumnRenamed("cutoff", "known"))
    lines = L.lineage(branches(spark, d), _leaf(log(spark, d)))
    seen = L.visible(memories(spark, d), lines, "branch_id", "cursor_seq")
    return seen.join(known, F.col("cursor_seq") <= F.col("known")).select("id", "cursor_seq", "supersedes_id")


@query("v07_lineage_links", f"WITH {SQL_MEMORIES} SELECT id, supersedes_id FROM mem WHERE supersedes_id IS NOT NULL")
def v07(spark, d):
    return memories(spark, d).where("supersedes_id is not null").select("id", "supersedes_id")


_SQL_VERSIONS = f"WITH RECURSIVE {SQL_MEMORIES}, chain(id, ancestor, steps) AS (SELECT id, id, CAST(0 AS BIGINT) FROM mem UNION ALL SELECT c.id, m.supersedes_id, c.steps + 1 FROM chain c JOIN mem m ON m.id = c.ancestor WHERE m.supersedes_id IS NOT NULL) "


@query("v08_ancestor_as_of", _SQL_VERSIONS + f", known AS (SELECT coalesce(max(seq), 0) AS cutoff FROM log WHERE created_at <= TIMESTAMP '{KNOWN_AT}') SELECT c.id, arg_min(c.ancestor, c.steps) AS as_of_id FROM chain c JOIN mem m ON m.id = c.ancestor, known WHERE m.cursor_seq <= known.cutoff GROUP BY 1")
def v08(spark, d):
    known = L.known_at(log(spark, d), F.lit(KNOWN_AT).cast("timestamp_ntz"))
    rows = memories(spark, d).crossJoin(F.broadcast(known))
    return L.ancestor_as_of(rows.withColumn("cursor_seq", F.col("cursor_seq") - F.col("cutoff")), F.lit(0))


@query("v09_version_history", _SQL_VERSIONS + "SELECT id, ancestor, steps FROM chain")
def v09(spark, d):
    return L.versions(memories(spark, d))


@query("v10_active_blocks", f"WITH {SQL_LOG} SELECT branch_id, arg_max(id, seq) AS id, max(seq) AS seq, arg_max(content, seq) AS content FROM log WHERE kind = 'memory_block' AND content IS NOT NULL GROUP BY 1")
def v10(spark, d):
    return L.active_blocks(log(spark, d, "content is not null"))


@query("v11_block_budget", f"WITH {SQL_LOG} SELECT branch_id, count(*) AS versions, CAST(sum(strlen(content)) AS BIGINT) AS bytes, sum(strlen(content)) > 3000 AS over_budget FROM log WHERE kind = 'memory_block' AND content IS NOT NULL GROUP BY 1")
def v11(spark, d):
    size = F.sum(F.octet_length("content"))
    return log(spark, d, "kind = 'memory_block' and content is not null").groupBy("branch_id").agg(F.count(F.lit(1)).alias("versions"), size.alias("bytes"), (size > 3000).alias("over_budget"))


@query("v13_provenance", f"WITH {SQL_MEMORIES} SELECT m.id, l.id AS event_id, l.kind, l.role FROM mem m JOIN log l ON l.id = m.source_event_id")
def v13(spark, d):
    events = log(spark, d).select(F.col("id").alias("event_id"), "kind", "role")
    return memories(spark, d).select("id", F.col("source_event_id").alias("event_id")).join(events, "event_id").select("id", "event_id", "kind", "role")


@query("v14_observed_at", f"WITH {SQL_MEMORIES} SELECT m.id, epoch_us(l.created_at) AS observed_us FROM mem m LEFT JOIN log l ON l.id = m.source_event_id")
def v14(spark, d):
    events = log(spark, d).select(F.col("id").alias("source_event_id"), F.expr("unix_micros(cast(created_at as timestamp))").alias("observed_us"))
    return memories(spark, d).select("id", "source_event_id").join(events, "source_event_id", "left").select("id", "observed_us")


@query("v15_source_violations", "SELECT DISTINCT q.id, q.source_event_id FROM finalization_quarantine q LEFT JOIN event_log e ON e.id = q.source_event_id AND lower(trim(e.role)) = 'assistant' WHERE e.id IS NULL")
def v15(spark, d):
    sources = log(spark, d, "role = 'assistant'").select(F.col("id").alias("source_event_id"))
    return read(spark, d, "finalization_quarantine").select("id", "source_event_id").distinct().join(sources, "source_event_id", "left_anti").select("id", "source_event_id")


@query("v16_derived_versions", f"WITH {SQL_MEMORIES} SELECT id, row_number() OVER (PARTITION BY example_id, memory_type ORDER BY ord, id) AS version, cursor_seq FROM mem")
def v16(spark, d):
    version = F.row_number().over(Window.partitionBy("example_id", "memory_type").orderBy("ord", "id"))
    return memories(spark, d).select("id", version.alias("version"), "cursor_seq")


@query("v17_eligible_memories", f"WITH {SQL_MEMORIES} SELECT m.id FROM mem m LEFT JOIN log l ON l.id = m.source_event_id AND l.role = 'assistant' WHERE l.id IS NULL")
def v17(spark, d):
    """Facts that no assistant message stands behind."""
    own = log(spark, d, "role = 'assistant'").select(F.col("id").alias("source_event_id"))
    return memories(spark, d).join(own, "source_event_id", "left_anti").select("id")


@query("v18_authority", f"WITH {SQL_MEMORIES} SELECT id, CASE WHEN initial_status = 'settled' THEN 'confirmed' WHEN initial_status = 'validated' THEN 'agent_finalized' ELSE 'unconfirmed' END AS authority FROM mem")
def v18(spark, d):
    authority = F.when(F.col("initial_status") == "settled", "confirmed").when(F.col("initial_status") == "validated", "agent_finalized").otherwise("unconfirmed")
    return memories(spark, d).select("id", authority.alias("authority"))


@query("v19_common_trace", f"WITH {SQL_LOG} SELECT session_id, CASE WHEN count(DISTINCT origin_adapter) = 1 AND count(origin_adapter) = count(*) THEN max(origin_adapter) END AS origin_adapter FROM log GROUP BY 1")
def v19(spark, d):
    return L.common_trace(log(spark, d), "session_id", "origin_adapter")
