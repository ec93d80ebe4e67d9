"""Packing, reduction, state and ledgers over the log and the facts (pack.., g.., i..)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators import assembly as A
from tracelake.operators import chain
from tracelake.operators import lineage as L
from tracelake.operators import pairing as P
from tracelake.plans import ordered as O
from tracelake.plans.cut import cut
from tracelake.registry import query
from tracelake.registry.analytics import _SQL_TOKENS, _SQL_USE, usage
from tracelake.registry.visibility import SQL_MSEEN, _leaf
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, branches, log, memories, read

# ---- packing


@query("pack01_rank_prefix", f"WITH {SQL_MEMORIES}, t AS (SELECT id, example_id, {_SQL_TOKENS} AS tokens, confidence FROM mem), s AS (SELECT *, sum(tokens) OVER (PARTITION BY example_id ORDER BY confidence DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM t) SELECT id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 60")
def pack01(spark, d):
    """The best facts of each example until 60 tokens would overflow."""
    rows = memories(spark, d).select("id", "example_id", "confidence", X.token_estimate(F.col("content")).alias("tokens"))
    return A.prefix_within(rows, ["example_id"], [F.desc("confidence"), F.col("id")], "tokens", 60).select("id", "spent")


@query("pack02_breadth_first")
def pack02(spark, d):
    """Facts of each run, one per example first, skipping what overflows."""
    rows = memories(spark, d).select("run_id", "id", "example_id", X.token_estimate(F.col("content")).alias("tokens"), (1 - F.col("confidence")).alias("rank"))
    return A.breadth_within(rows, "run_id", "example_id", "tokens", "rank", 200)


@query("pack03_rendered_groups", f"WITH {SQL_MEMORIES} SELECT example_id, string_agg('- ' || content, chr(10) ORDER BY ord, id) AS rendered FROM mem WHERE content IS NOT NULL GROUP BY 1")
def pack03(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("ord", "id", F.concat(F.lit("- "), "content").alias("line"))))
    rows = memories(spark, d).where("content is not null").groupBy("example_id").agg(lines.alias("lines"))
    return rows.select("example_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("rendered"))


_SQL_GROUPS = f"""{_SQL_USE}, tr AS (SELECT id, session_id, seq, kind, json_extract_string(payload_json, '$.call_id') AS call_id FROM log WHERE session_id IS NOT NULL AND kind IN ('message', 'tool_call', 'tool_output')),
s1 AS (SELECT *, CASE WHEN kind = 'tool_call' THEN 1 ELSE -1 END AS step FROM tr WHERE call_id IS NOT NULL AND kind <> 'message'),
d1 AS (SELECT *, sum(step) OVER (PARTITION BY session_id, call_id ORDER BY seq) AS depth FROM s1),
l1 AS (SELECT *, depth - least(0, min(depth) OVER (PARTITION BY session_id, call_id ORDER BY seq)) + CASE WHEN step = 1 THEN 0 ELSE 1 END AS level FROM d1),
p1 AS (SELECT seq, step, lag(CASE WHEN step = 1 THEN seq END) OVER (PARTITION BY session_id, call_id, level ORDER BY seq) AS own FROM l1),
n1 AS (SELECT seq, own FROM p1 WHERE step = -1 AND own IS NOT NULL),
s2 AS (SELECT *, CASE WHEN kind = 'tool_call' THEN 1 ELSE -1 END AS step FROM tr WHERE kind <> 'message' AND seq NOT IN (SELECT seq FROM n1 UNION ALL SELECT own FROM n1)),
d2 AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY seq) AS depth FROM s2),
l2 AS (SELECT *, depth - least(0, min(depth) OVER (PARTITION BY session_id ORDER BY seq)) + CASE WHEN step = 1 THEN 0 ELSE 1 END AS level FROM d2),
p2 AS (SELECT seq, step, lag(CASE WHEN step = 1 THEN seq END) OVER (PARTITION BY session_id, level ORDER BY seq) AS own FROM l2),
pairs AS (SELECT seq, own FROM n1 UNION ALL SELECT seq, own FROM p2 WHERE step = -1 AND own IS NOT NULL),
grp AS (SELECT tr.id, tr.session_id, tr.seq, tr.kind, coalesce(pairs.own, tr.seq) AS grp FROM tr LEFT JOIN pairs ON pairs.seq = tr.seq WHERE tr.kind <> 'tool_output' OR pairs.own IS NOT NULL)"""


def groups(spark, d):
    """(session_id, id, seq, kind, grp): the interaction groups of each session."""
    return P.call_groups(log(spark, d, "session_id is not null"), ["session_id"]).select("session_id", "id", "seq", "kind", "grp")


#: The room for a session's context, and of it what is kept for retrieval.
CONTEXT_TOKENS, RESERVE = 1500, min(400, 1500 // 3)


@query("pack04_newest_groups", f"WITH {_SQL_GROUPS}, g AS (SELECT grp.session_id, grp, sum(tokens) AS tokens FROM grp JOIN u ON u.id = grp.id GROUP BY 1, 2 HAVING sum(tokens) > 0), s AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY grp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM g) SELECT session_id, grp, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= {CONTEXT_TOKENS - RESERVE}")
def pack04(spark, d):
    """The newest complete groups of each session within the room that the reserve for retrieval leaves; groups without text take none."""
    sized = groups(spark, d).join(usage(spark, d).select("id", "tokens"), "id").groupBy("session_id", "grp").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    rows = sized.withColumn("id", F.col("grp"))
    return A.prefix_within(rows, ["session_id"], [F.desc("grp")], "tokens", CONTEXT_TOKENS - RESERVE).select("session_id", "grp", "spent")


@query("pack06_active_files", f"WITH {_SQL_GROUPS}, o AS (SELECT session_id, grp, dense_rank() OVER (PARTITION BY session_id ORDER BY grp DESC) AS back FROM (SELECT DISTINCT session_id, grp FROM grp)), f AS (SELECT grp.session_id, grp.id, o.back, unnest(l.files) AS file FROM grp JOIN o ON o.session_id = grp.session_id AND o.grp = grp.grp JOIN log l ON l.id = grp.id WHERE o.back <= 40), act AS (SELECT DISTINCT session_id, file FROM f WHERE back <= 5) SELECT DISTINCT f.session_id, f.id, act.file IS NOT NULL AS held FROM f LEFT JOIN act ON act.session_id = f.session_id AND act.file = f.file")
def pack06(spark, d):
    """Of the last forty groups of each session, the rows that name files: held as they are where a file is one of the last five groups'."""
    rows = groups(spark, d)
    heads = O.last_of_each(rows.where("seq = grp").select("session_id", "seq", "grp"), ["session_id"], "seq", 40).select("session_id", "grp", "back")
    named = rows.join(heads, ["session_id", "grp"]).join(log(spark, d, "size(files) > 0").select("id", F.explode("files").alias("file")), "id")
    active = named.where("back <= 5").select("session_id", "file").distinct().withColumn("held", F.lit(True))
    return named.join(active, ["session_id", "file"], "left").select("session_id", "id", F.coalesce("held", F.lit(False)).alias("held")).distinct()


@query("pack05_folded_bodies", f"WITH {SQL_LOG}, f AS (SELECT id, first_value(id) OVER (PARTITION BY md5(content) ORDER BY seq) AS first_id FROM log WHERE length(content) >= 240) SELECT id, first_id AS same_as FROM f WHERE id <> first_id")
def pack05(spark, d):
    rows = log(spark, d).select("id", "seq", "content")
    return A.folded(rows, "content", "seq").where("same_as is not null").select("id", "same_as")


#: Tokens for the lines of an index and for a compaction; groups that a compaction leaves as they are.
INDEX_TOKENS, COMPACT_TOKENS, KEPT_GROUPS = 200, 600, 8
_SQL_LINE = r"seq || ' ' || kind || ' ' || substr(trim(regexp_replace(content, '[\s\p{Z}]+', ' ', 'g')), 1, 80)"


@query("pack07_index_lines", f"WITH {SQL_LOG}, i AS (SELECT session_id, id, seq, {_SQL_LINE} AS line FROM log WHERE session_id IS NOT NULL AND content IS NOT NULL AND content <> '' AND NOT regexp_matches(content, '{X.FAILURE}')), t AS (SELECT *, {_SQL_TOKENS.replace('content', 'line')} AS tokens FROM i), s AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY seq DESC, id) AS spent FROM t) SELECT session_id, id, line FROM s WHERE spent <= {INDEX_TOKENS}")
def pack07(spark, d):
    """The newest events of each session as lines of an index, until its room is full; failures have no line."""
    rows = log(spark, d, F.col("session_id").isNotNull() & (F.col("content") != "") & ~F.col("content").rlike(X.FAILURE))
    lines = rows.select("session_id", "id", "seq", F.concat_ws(" ", F.col("seq").cast("string"), "kind", X.preview(F.col("content"), 80)).alias("line"))
    lines = lines.withColumn("tokens", X.token_estimate(F.col("line")))
    return A.prefix_within(lines, ["session_id"], [F.desc("seq")], "tokens", INDEX_TOKENS).select("session_id", "id", "line")


@query("pack10_compaction", f"WITH {_SQL_GROUPS}, o AS (SELECT session_id, grp, dense_rank() OVER (PARTITION BY session_id ORDER BY grp DESC) AS back FROM (SELECT DISTINCT session_id, grp FROM grp)), r AS (SELECT grp.session_id, grp.id, grp.seq, u.tokens FROM grp JOIN o ON o.session_id = grp.session_id AND o.grp = grp.grp JOIN u ON u.id = grp.id JOIN log l ON l.id = grp.id WHERE o.back > {KEPT_GROUPS} AND u.tokens > 0 AND NOT (l.kind = 'message' AND coalesce(l.role, '') = 'assistant')), s AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY seq DESC, id) AS spent FROM r) SELECT session_id, id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= {COMPACT_TOKENS}")
def pack10(spark, d):
    """What a compaction takes of each session: the newest of what is older than the last eight groups, without assistant messages, until its room is full."""
    rows = groups(spark, d)
    heads = O.last_of_each(rows.where("seq = grp").select("session_id", "seq", "grp"), ["session_id"], "seq", KEPT_GROUPS).select("session_id", "grp")
    own = log(spark, d, "kind = 'message' and role = 'assistant'").select("id")
    old = rows.join(heads, ["session_id", "grp"], "left_anti").join(own, "id", "left_anti").join(usage(spark, d).select("id", "tokens").where("tokens > 0"), "id")
    return A.prefix_within(old, ["session_id"], [F.desc("seq")], "tokens", COMPACT_TOKENS).select("session_id", "id", "spent")


@query("w16_latest_groups", f"WITH {_SQL_GROUPS}, g AS (SELECT session_id, grp, count(*) AS n FROM grp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY grp DESC) AS back FROM g) SELECT session_id, grp, n FROM r WHERE back <= 2")
def w16(spark, d):
    """The two newest interaction groups of each session."""
    sizes = groups(spark, d).groupBy("session_id", "grp").agg(F.count(F.lit(1)).alias("n"))
    return O.last_of_each(sizes, ["session_id"], "grp", 2).select("session_id", "grp", "n")


#: Room of a resume packet, and how many open questions it names.
RESUME_TOKENS, PENDING = 1500, 3


@query(
    "pack08_resume",
    f"""WITH {_SQL_GROUPS}, own AS (SELECT u.id, u.session_id, u.seq, u.tokens, l.kind, l.role, l.content FROM u JOIN log l ON l.id = u.id WHERE u.session_id IS NOT NULL AND u.tokens > 0),
k AS (SELECT *, CASE WHEN kind = 'state' THEN 0 WHEN kind = 'memory_block' THEN 1 END AS section FROM own), st AS (SELECT session_id, section, id, seq, tokens, row_number() OVER (PARTITION BY session_id, section ORDER BY seq DESC) AS nth FROM k WHERE section IS NOT NULL),
pe AS (SELECT session_id, 2 AS section, id, seq, tokens, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS nth FROM own WHERE kind = 'message' AND role = 'user' AND content LIKE '%?'),
gr AS (SELECT own.session_id, 3 AS section, own.id, own.seq, own.tokens FROM own JOIN grp USING (id) WHERE NOT (own.kind = 'message' AND coalesce(own.role, '') = 'assistant') AND own.id NOT IN (SELECT id FROM pe WHERE nth <= {PENDING})),
al AS (SELECT session_id, section, id, seq, tokens FROM st WHERE nth = 1 UNION ALL SELECT session_id, section, id, seq, tokens FROM pe WHERE nth <= {PENDING} UNION ALL SELECT * FROM gr),
sp AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY section, seq DESC, id) AS spent FROM al) SELECT session_id, section, id, CAST(spent AS BIGINT) AS spent FROM sp WHERE spent <= {RESUME_TOKENS}""",
)
def pack08(spark, d):
    """What a session goes on from: its last snapshot, its last block, its newest open questions and the newest rows of its groups
    without the assistant's own words, in this order until the room is full."""
    sized = usage(spark, d).where("session_id is not null and tokens > 0").select("id", "session_id", "seq", "tokens")
    own = cut(sized.join(log(spark, d, "session_id is not null").select("id", "kind", "role", F.col("content").like("%?").alias("asks")), "id"))
    part = lambda rows, n: rows.select("session_id", F.lit(n).alias("section"), "id", "seq", "tokens")
    last = lambda kind, n: part(O.last_of_each(own.where(F.col("kind") == kind), ["session_id"], "seq", 1), n)
    pending = part(O.last_of_each(own.where("kind = 'message' and role = 'user' and asks"), ["session_id"], "seq", PENDING), 2)
    rest = own.where(~((F.col("kind") == "message") & (F.coalesce("role", F.lit("")) == "assistant"))).join(groups(spark, d).select("id"), "id", "left_semi").join(pending.select("id"), "id", "left_anti")
    rows = last("state", 0).unionByName(last("memory_block", 1)).unionByName(pending).unionByName(part(rest, 3))
    return A.prefix_within(rows, ["session_id"], [F.col("section"), F.desc("seq")], "tokens", RESUME_TOKENS).select("session_id", "section", "id", "spent")


@query("pack11_without_assistant", f"WITH {SQL_MEMORIES} SELECT m.id FROM mem m JOIN log l ON l.id = m.source_event_id WHERE coalesce(l.role, '') <> 'assistant'")
def pack11(spark, d):
    events = log(spark, d, "coalesce(role, '') <> 'assistant'").select(F.col("id").alias("source_event_id"))
    return memories(spark, d).join(events, "source_event_id", "left_semi").select("id")


# ---- reduction and state


@query("g01_call_groups", f"WITH {_SQL_GROUPS} SELECT id, grp FROM grp")
def g01_calls(spark, d):
    """Messages, calls and outputs of a session by group: outputs with their call, outputs without one left out."""
    return groups(spark, d).select("id", "grp")


@query("g01_interaction_groups", f"WITH {SQL_LOG} SELECT id, CAST(sum(CASE WHEN kind = 'message' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS grp FROM log WHERE session_id IS NOT NULL")
def g01(spark, d):
    """Events of a session by the number of the user's message that they follow, over the whole session."""
    opens = ((F.col("kind") == "message") & F.coalesce(F.col("role") == "user", F.lit(False))).cast("int")
    rows = log(spark, d, "session_id is not null").select("id", "session_id", "seq", opens.alias("opens"))
    return O.with_running_sum(rows, ["session_id"], "seq", F.col("opens"), "grp").select("id", "grp")


@query("g03_search_places", f"WITH {SQL_LOG}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM log WHERE kind = 'tool_output' AND content IS NOT NULL) SELECT DISTINCT id, lower(regexp_extract(line, '{X.PATH_LINE}', 1)) || ':' || regexp_extract(line, '{X.PATH_LINE}', 2) AS place FROM l WHERE regexp_matches(line, '{X.PATH_LINE}')")
def g03(spark, d):
    lines = log(spark, d, "kind = 'tool_output' and content is not null").select("id", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(X.PATH_LINE))
    return lines.select("id", F.concat(F.lower(F.regexp_extract("line", X.PATH_LINE, 1)), F.lit(":"), F.regexp_extract("line", X.PATH_LINE, 2)).alias("place")).distinct()


@query("g09_built_state", f"WITH {SQL_MEMORIES}, l AS (SELECT branch_id, count(*) AS events, max(seq) AS cursor, arg_max(CASE WHEN kind = 'memory_block' THEN id END, CASE WHEN kind = 'memory_block' THEN seq END) AS block FROM log GROUP BY 1), m AS (SELECT branch_id, count(*) AS facts FROM mem GROUP BY 1) SELECT l.branch_id, l.events, l.cursor, l.block, coalesce(m.facts, 0) AS facts FROM l LEFT JOIN m ON m.branch_id = l.branch_id")
def g09(spark, d):
    """Materialised state of each branch: its cursor, last block and number of facts."""
    block = F.struct(F.when(F.col("kind") == "memory_block", F.col("seq")).alias("at"), F.when(F.col("kind") == "memory_block", F.col("id")).alias("id"))
    events = log(spark, d).groupBy("branch_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("cursor"), F.max(block)["id"].alias("block"))
    facts = memories(spark, d).groupBy("branch_id").agg(F.count(F.lit(1)).alias("facts"))
    return events.join(facts, "branch_id", "left").select("branch_id", "events", "cursor", "block", F.coalesce("facts", F.lit(0)).alias("facts"))


# the state of each branch: version, cursor, last block and the facts that nothing on the branch supersedes
def _sql_state(name: str, events: str, facts: str) -> str:
    return f"""{name}_e AS (SELECT lower(trim(branch_id)) AS branch, count(*) AS version, max(seq) AS cursor, max(CASE WHEN kind = 'memory_block' THEN seq END) AS block_at, arg_max(CASE WHEN kind = 'memory_block' THEN id END, CASE WHEN kind = 'memory_block' THEN seq END) AS block FROM log WHERE {events} GROUP BY 1),
{name}_f AS (SELECT branch_id AS branch, id FROM mem WHERE {facts} AND id NOT IN (SELECT supersedes_id FROM mem WHERE supersedes_id IS NOT NULL AND {facts}))"""


def _state(events, facts):
    """(branch, version, cursor, block_at, block) and (branch, id): what the events and facts make of each branch."""
    at = F.when(F.col("kind") == "memory_block", F.col("seq"))
    branch = F.lower(F.trim("branch_id")).alias("branch")
    heads = events.groupBy(branch).agg(F.count(F.lit(1)).alias("version"), F.max("seq").alias("cursor"), F.max(at).alias("block_at"), F.max_by("id", at).alias("block"))
    return heads, L.without_superseded(facts).select(F.col("branch_id").alias("branch"), "id")


def _summed(heads, live):
    """A state as one row per branch, its facts as their number and an order-free digest."""
    digest = F.sum(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint"))
    facts = live.groupBy("branch").agg(F.count(F.lit(1)).alias("facts"), digest.alias("digest"))
    return heads.join(facts, "branch", "left").select("branch", "version", "cursor", "block", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("digest", F.lit(0)).alias("digest"))


_SQL_SUMMED = "SELECT h_e.branch, version, cursor, block, count(h_f.id) AS facts, CAST(coalesce(sum(CAST('0x' || substr(md5(h_f.id), 1, 8) AS BIGINT)), 0) AS BIGINT) AS digest FROM h_e LEFT JOIN h_f USING (branch) GROUP BY ALL"


@query("g10_replayed_state", f"WITH {SQL_MEMORIES}, {_sql_state('h', 'true', 'true')} {_SQL_SUMMED}")
def g10(spark, d):
    """The state at the head of each branch, folded from a snapshot at half of the log and what came after it.

    The last block of the tail replaces the snapshot's, its facts join the snapshot's, and what the tail supersedes leaves.
    """
    events, facts = log(spark, d), memories(spark, d)
    middle = F.broadcast(read(spark, d, "event_log").agg(F.expr("max(seq) div 2").alias("middle")))
    split = lambda rows, at: (rows.join(middle, F.col(at) <= F.col("middle")).drop("middle"), rows.join(middle, F.col(at) > F.col("middle")).drop("middle"))
    (old, tail), (known, derived) = split(events, "seq"), split(facts, "cursor_seq")
    base, base_live = _state(old, known)
    more, more_live = _state(tail, derived)
    out = base.alias("b").join(more.alias("t"), "branch", "full_outer")
    later = F.col("t.block_at").isNotNull()
    heads = out.select("branch", (F.coalesce("b.version", F.lit(0)) + F.coalesce("t.version", F.lit(0))).alias("version"), F.coalesce("t.cursor", "b.cursor").alias("cursor"), F.when(later, F.col("t.block")).otherwise(F.col("b.block")).alias("block"))
    over = derived.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct()
    return _summed(heads, base_live.unionByName(more_live).join(over, "id", "left_anti"))


_SQL_DELTAS = SQL_MSEEN + """, seen_f AS (SELECT m.* FROM mem m JOIN lines l ON m.branch_id = l.ancestor WHERE l.branch IN (SELECT branch FROM leaf) AND (l.cutoff IS NULL OR m.cursor_seq <= l.cutoff)),
last_f AS (SELECT example_id, memory_type, arg_max(id, (cursor_seq, id)) AS id, arg_max(initial_status, (cursor_seq, id)) AS status FROM seen_f GROUP BY 1, 2)"""


@query("g11_folded_deltas", _SQL_DELTAS + " SELECT example_id, memory_type, id FROM last_f WHERE status <> 'rejected'")
def g11(spark, d):
    """The deltas of a branch and its ancestors, each a fact set under its example and type or, if rejected, taken away:
    the last one of each key along the chain decides."""
    seen = L.visible(memories(spark, d), L.lineage(branches(spark, d), _leaf(log(spark, d))), "branch_id", "cursor_seq")
    last = seen.groupBy("example_id", "memory_type").agg(F.max(F.struct("cursor_seq", "id", "initial_status")).alias("d"))
    return last.where("d.initial_status <> 'rejected'").select("example_id", "memory_type", "d.id")


@query("g12_latest_snapshot", f"WITH {SQL_LOG}, s AS (SELECT branch_id, max(seq) AS cursor, arg_max(id, seq) AS id FROM log WHERE kind = 'state' AND content IS NOT NULL GROUP BY 1) SELECT s.branch_id, s.cursor, s.id, count(l.id) AS tail FROM s LEFT JOIN log l ON l.branch_id = s.branch_id AND l.seq > s.cursor GROUP BY ALL")
def g12(spark, d):
    """The last snapshot of each branch that has content, with the number of events behind it."""
    events = log(spark, d).select("branch_id", "seq", "id", ((F.col("kind") == "state") & F.col("content").isNotNull()).alias("snapshot"))
    last = events.where("snapshot").groupBy("branch_id").agg(F.max("seq").alias("cursor"), F.max_by("id", "seq").alias("last_id"))
    tails = events.join(last, "branch_id").groupBy("branch_id", "cursor", F.col("last_id").alias("id")).agg(F.count_if(F.col("seq") > F.col("cursor")).alias("tail"))
    return tails.select("branch_id", "cursor", "id", "tail")


@query("g13_closed_facts", f"WITH {SQL_MEMORIES} SELECT id, lead(id) OVER w AS closed_by, epoch_us(lead(created_at) OVER w) AS closed_us FROM mem WINDOW w AS (PARTITION BY example_id, memory_type ORDER BY ord, id)")
def g13(spark, d):
    """Facts with the later version that closes them."""
    w = Window.partitionBy("example_id", "memory_type").orderBy("ord", "id")
    return memories(spark, d).withColumn("at", F.lead("created_at").over(w)).select("id", F.lead("id").over(w).alias("closed_by"), F.expr("unix_micros(cast(at as timestamp))").alias("closed_us"))


_SQL_STATUS = "CASE WHEN evidence_quote IS NULL OR evidence_quote = '' THEN 'rejected:empty_evidence' WHEN evidence_zone <> 'prose' THEN 'quarantined:untrusted_evidence_zone:' || evidence_zone WHEN evidence_start IS NULL THEN 'rejected:evidence_not_found' WHEN confidence < 0.85 THEN 'quarantined:below_auto_threshold' ELSE 'auto:exact_prose_above_threshold' END"


@query("g15_initial_status", f"SELECT DISTINCT id, {_SQL_STATUS} AS status FROM candidates")
def g15(spark, d):
    status = (
        F.when(F.coalesce("evidence_quote", F.lit("")) == "", "rejected:empty_evidence")
        .when(F.col("evidence_zone") != "prose", F.concat(F.lit("quarantined:untrusted_evidence_zone:"), "evidence_zone"))
        .when(F.col("evidence_start").isNull(), "rejected:evidence_not_found")
        .when(F.col("confidence") < 0.85, "quarantined:below_auto_threshold")
        .otherwise("auto:exact_prose_above_threshold")
    )
    return read(spark, d, "candidates").select("id", status.alias("status")).distinct()


@query("g16_commit_outcome", f"WITH {SQL_MEMORIES}, k AS (SELECT example_id, memory_type, count(DISTINCT lower(content)) AS variants FROM mem GROUP BY 1, 2) SELECT m.id, CASE WHEN k.variants > 1 THEN 'quarantined' WHEN m.supersedes_id IS NOT NULL THEN 'support' ELSE 'derive' END AS outcome FROM mem m JOIN k ON k.example_id = m.example_id AND k.memory_type = m.memory_type")
def g16(spark, d):
    rows = memories(spark, d)
    variants = rows.groupBy("example_id", "memory_type").agg(F.count_distinct(F.lower("content")).alias("variants"))
    outcome = F.when(F.col("variants") > 1, "quarantined").when(F.col("supersedes_id").isNotNull(), "support").otherwise("derive")
    return rows.join(variants, ["example_id", "memory_type"]).select("id", outcome.alias("outcome"))


@query("g17_run_status", "SELECT run_id, CASE WHEN count(CASE WHEN initial_status = 'settled' THEN 1 END) > 0 THEN 'done' WHEN arg_max(initial_status, ord) = 'rejected' THEN 'failed' WHEN count(CASE WHEN initial_status = 'validated' THEN 1 END) > 0 THEN 'running' ELSE 'pending' END AS status FROM candidates GROUP BY 1")
def g17(spark, d):
    status = (
        F.when(F.count_if(F.col("initial_status") == "settled") > 0, "done")
        .when(F.max_by("initial_status", "ord") == "rejected", "failed")
        .when(F.count_if(F.col("initial_status") == "validated") > 0, "running")
        .otherwise("pending")
    )
    return read(spark, d, "candidates").groupBy("run_id").agg(status.alias("status"))


# The budget's window and ratios.
WINDOW_TOKENS, SNAPSHOT, COMPACT, HANDOFF, HARD = 4000, 0.45, 0.60, 0.75, 0.90


@query("g18_budget_actions", f"WITH {_SQL_USE}, t AS (SELECT session_id, sum(tokens) AS used FROM u WHERE session_id IS NOT NULL GROUP BY 1) SELECT session_id, CAST(used AS BIGINT) AS used, CASE WHEN used >= ceil({WINDOW_TOKENS} * {HARD}) THEN 'hard_stop' WHEN used >= ceil({WINDOW_TOKENS} * {HANDOFF}) THEN 'handoff' WHEN used >= ceil({WINDOW_TOKENS} * {COMPACT}) THEN 'compact' WHEN used >= ceil({WINDOW_TOKENS} * {SNAPSHOT}) THEN 'snapshot' ELSE 'none' END AS action FROM t")
def g18(spark, d):
    used = usage(spark, d).where("session_id is not null").groupBy("session_id").agg(F.sum("tokens").alias("used"))
    action = F.lit(None)
    for ratio, name in ((HARD, "hard_stop"), (HANDOFF, "handoff"), (COMPACT, "compact"), (SNAPSHOT, "snapshot")):
        action = F.coalesce(action, F.when(F.col("used") >= F.ceil(F.lit(WINDOW_TOKENS * ratio)), name))
    return used.select("session_id", "used", F.coalesce(action, F.lit("none")).alias("action"))


# Allowed status changes of a candidate.
ALLOWED = (("validated", "settled"), ("validated", "rejected"), ("rejected", "validated"), ("settled", "settled"), ("validated", "validated"), ("rejected", "rejected"))


@query("g21_bad_transitions", f"WITH {SQL_MEMORIES}, t AS (SELECT id, lag(initial_status) OVER (PARTITION BY example_id, memory_type ORDER BY ord, id) AS before, initial_status AS after FROM mem) SELECT id, before, after FROM t WHERE before IS NOT NULL AND (before, after) NOT IN ({', '.join(f'({a!r}, {b!r})' for a, b in ALLOWED)})")
def g21(spark, d):
    """Status changes from one version of a fact to the next that the state machine does not allow."""
    before = F.lag("initial_status").over(Window.partitionBy("example_id", "memory_type").orderBy("ord", "id"))
    steps = memories(spark, d).select("id", before.alias("before"), F.col("initial_status").alias("after")).where("before is not null")
    allowed = spark.createDataFrame(ALLOWED, "before string, after string")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti").select("id", "before", "after")


@query("g22_finalizations", "SELECT DISTINCT q.id, q.source_event_id, coalesce(q.reason_code, 'unclassified') AS reason FROM finalization_quarantine q JOIN event_log e ON e.id = q.source_event_id")
def g22(spark, d):
    sources = log(spark, d).select(F.col("id").alias("source_event_id"))
    rows = read(spark, d, "finalization_quarantine").join(sources, "source_event_id")
    return rows.select("id", "source_event_id", F.coalesce("reason_code", F.lit("unclassified")).alias("reason")).distinct()


@query("g23_cheapest_placement", f"WITH {SQL_MEMORIES}, c AS (SELECT example_id, id, round(retrieval_cost * 2 + risk, 6) AS cost FROM mem) SELECT example_id, arg_min(id, cost) AS id FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY cost, id) AS nth FROM c) WHERE nth = 1 GROUP BY 1")
def g23(spark, d):
    """The cheapest fact of each example, the smallest id among equals; null where no fact's cost is known."""
    cost = F.round(F.col("retrieval_cost") * 2 + F.col("risk"), 6)
    return memories(spark, d).groupBy("example_id").agg(F.min(F.when(cost.isNotNull(), F.struct(cost.alias("cost"), "id")))["id"].alias("id"))


@query("g26_native_failures", rf"WITH {SQL_LOG}, c AS (SELECT json_extract_string(payload_json, '$.call_id') AS call_id, * FROM log WHERE kind IN ('tool_call', 'tool_output')), f AS (SELECT b.id, b.seq, b.session_id, a.content AS tool, substr(list_filter(list_transform(string_split_regex(b.content, '\r\n?|\n'), lambda l: trim(regexp_replace(l, '[\s\p{{Z}}]+', ' ', 'g'))), lambda l: regexp_matches(l, '{X.FAILURE}'))[1], 1, 240) AS line FROM c a JOIN c b ON a.call_id = b.call_id AND a.kind = 'tool_call' AND b.kind = 'tool_output' WHERE regexp_matches(b.content, '{X.FAILURE}')) SELECT session_id, tool, line, arg_min(id, seq) AS id, count(*) AS times FROM f GROUP BY 1, 2, 3")
def g26(spark, d):
    """Failures of tools, each once per session, tool and first line that tells it, at its first output."""
    rows = log(spark, d, "kind in ('tool_call', 'tool_output')").withColumn("call_id", F.get_json_object("payload_json", "$.call_id"))
    calls = rows.where("kind = 'tool_call'").select("call_id", F.col("content").alias("tool"))
    failed = rows.where((F.col("kind") == "tool_output") & F.col("content").rlike(X.FAILURE)).select("call_id", "id", "seq", "session_id", X.first_failure_line(F.col("content")).alias("line"))
    return failed.join(calls, "call_id").groupBy("session_id", "tool", "line").agg(F.min_by("id", "seq").alias("id"), F.count(F.lit(1)).alias("times"))


_SQL_WITNESS = "created_at < TIMESTAMP '2024-01-15 00:00:00'"


@query("g27_witness", f"WITH {SQL_LOG}, h AS (SELECT branch_id, max(seq) AS head FROM log GROUP BY 1), s AS (SELECT branch_id, max(seq) AS seen, arg_max(chain_hash, seq) AS hash FROM log WHERE {_SQL_WITNESS} GROUP BY 1) SELECT h.branch_id, CASE WHEN s.seen IS NULL THEN 'new' WHEN h.head < s.seen THEN 'rollback' WHEN l.id IS NULL THEN 'replacement' WHEN l.chain_hash IS DISTINCT FROM s.hash THEN 'divergence' WHEN h.head = s.seen THEN 'unchanged' ELSE 'extension' END AS verdict FROM h LEFT JOIN s ON s.branch_id = h.branch_id LEFT JOIN log l ON l.branch_id = h.branch_id AND l.seq = s.seen")
def g27(spark, d):
    """Branch heads against the heads and hashes that a witness saw earlier."""
    events = log(spark, d).select("branch_id", "seq", "id", "chain_hash", "created_at")
    seen = events.where(F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("branch_id").agg(F.max("seq").alias("seen"), F.max_by("chain_hash", "seq").alias("hash"))
    return chain.witnessed(events, seen)


@query("i02_chain_faults", f"WITH {SQL_LOG}, l AS (SELECT *, lag(chain_hash) OVER (ORDER BY seq) AS before FROM log) SELECT seq, id, CASE WHEN before IS NOT NULL AND previous_hash <> before THEN 'broken_link' ELSE 'broken_hash' END AS fault FROM l WHERE previous_hash IS NOT NULL AND ((before IS NOT NULL AND previous_hash <> before) OR sha256(previous_hash || content_hash) <> chain_hash)")
def i02(spark, d):
    return chain.verify(log(spark, d))
