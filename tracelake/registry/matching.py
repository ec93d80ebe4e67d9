"""Matching of facts, spans and identifiers, and smaller lookups (f02, f11, f34, f35, j07, j09, j11, j12, j17, j22, j26, r14, s08, u03, v20, w10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import temporal as T
from tracelake.functions import text as X
from tracelake.operators import assembly as A
from tracelake.operators import markup
from tracelake.plans.cut import cut
from tracelake.registry import query
from tracelake.registry.analytics import _SQL_TOKENS
from tracelake.registry.retrieval import _SQL_FRESH, QUERY, _fresh, _rel_sql
from tracelake.registry.temporal import _FACTS, _facts, _sql_lt
from tracelake.registry.texts import fact_terms, fact_terms_sql, terms_sql
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, log, memories, read

# ---- texts


@query("f02_match_queries", f"WITH {SQL_MEMORIES} SELECT id, array_to_string(list_transform(list_sort({terms_sql('content')}), lambda t: '\"' || replace(t, '\"', '\"\"') || '\"'), ' OR ') AS match FROM mem WHERE content IS NOT NULL")
def f02(spark, d):
    """Each fact as a full-text query: its terms, quoted, any of them."""
    quoted = F.transform(F.array_sort(X.terms(F.col("content"))), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return memories(spark, d).where("content is not null").select("id", F.array_join(quoted, " OR ").alias("match"))


@query("f11_redacted_values")
def f11(spark, d):
    """Payloads and tool outputs that are JSON, with the values of keys that name secrets and the secrets in their texts redacted."""
    rows = log(spark, d).select("id", F.coalesce(F.when(F.col("content").rlike(r"^\s*[\[{]"), F.col("content")), F.col("payload_json")).alias("text"))
    return rows.select("id", markup.redacted_json("text").alias("r")).select("id", "r.*").where("text is not null")


def state_key(column: Column) -> Column:
    """A key of parts between bars: lower case, blanks, underscores and hyphens as one hyphen, empty parts left out."""
    part = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[\s_-]+", "-"), "^-+|-+$", "")
    return F.array_join(F.filter(F.transform(F.split(column, r"\|"), part), lambda x: x != ""), "|")


@query("f34_state_keys", rf"WITH {SQL_MEMORIES} SELECT key, count(*) AS n FROM (SELECT array_to_string(list_filter(list_transform(string_split(memory_type || ' | ' || coalesce(evidence_zone, '') || '|' || example_id, '|'), lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> ''), '|') AS key FROM mem) GROUP BY 1")
def f34(spark, d):
    raw = F.concat("memory_type", F.lit(" | "), F.coalesce("evidence_zone", F.lit("")), F.lit("|"), "example_id")
    return memories(spark, d).groupBy(state_key(raw).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def last_verdict(column: Column) -> Column:
    """The last boxed yes or no of a text, null if there is none."""
    found = F.regexp_extract_all(column, F.lit(r"(?i)\\boxed\{\s*(?:\\text\{)?\s*(yes|no)\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.lower(F.element_at(found, -1)) == "yes")




@query("f35_boxed_verdicts", r"WITH v AS (SELECT DISTINCT vote_id, concat_ws(' ', rationale, '\boxed{No}', '\boxed{' || coalesce(rejudged, rejudge_correct, '') || '}') AS said FROM rejudge_labels), e AS (SELECT vote_id, regexp_extract_all(said, '(?i)\\boxed\{\s*(?:\\text\{)?\s*(yes|no)\b', 1) AS f FROM v) SELECT vote_id, CASE WHEN len(f) > 0 THEN lower(f[-1]) = 'yes' END AS verdict FROM e")
def f35(spark, d):
    """The last boxed verdict of each vote, its rationale and verdicts written as a judge's reply; what is neither yes nor no is none."""
    said = F.concat_ws(" ", "rationale", F.lit("\\boxed{No}"), F.concat(F.lit("\\boxed{"), F.coalesce("rejudged", "rejudge_correct", F.lit("")), F.lit("}")))
    return read(spark, d, "rejudge_labels").select("vote_id", said.alias("said")).distinct().select("vote_id", last_verdict(F.col("said")).alias("verdict"))


# ---- joins


@query("j07_candidate_links", "WITH c AS (SELECT DISTINCT id, example_id, evidence_quote FROM candidates), e AS (SELECT DISTINCT id AS example_id, q.evidence_quote AS quote, q.memory_type AS memory_type FROM (SELECT id, unnest(expected) AS q FROM extraction_examples)) SELECT c.id, min(e.memory_type) AS linked_type, count(e.quote) AS links FROM c LEFT JOIN e ON e.example_id = c.example_id AND e.quote = c.evidence_quote GROUP BY 1")
def j07(spark, d):
    """Every candidate with the expected facts that it is linked to by its quote, if any."""
    gold = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), F.explode("expected").alias("q")).select("example_id", F.col("q.evidence_quote").alias("evidence_quote"), "q.memory_type").distinct()
    said = read(spark, d, "candidates").select("id", "example_id", "evidence_quote").distinct()
    return said.join(gold, ["example_id", "evidence_quote"], "left").groupBy("id").agg(F.min("memory_type").alias("linked_type"), F.count("memory_type").alias("links"))


@query("j09_last_actions", f"WITH {SQL_LOG}, b AS (SELECT DISTINCT lower(trim(branch_id)) AS branch FROM log), a AS (SELECT lower(trim(branch_id)) AS branch, max(seq) AS last_seq, arg_max(id, seq) AS last_id FROM log WHERE kind = 'memory_block' GROUP BY 1) SELECT b.branch, a.last_seq, a.last_id FROM b LEFT JOIN a USING (branch)")
def j09(spark, d):
    """Every branch with its last block, null where it has none."""
    at = F.when(F.col("kind") == "memory_block", F.col("seq"))
    return log(spark, d).groupBy(F.lower(F.trim("branch_id")).alias("branch")).agg(F.max(at).alias("last_seq"), F.max_by("id", at).alias("last_id"))


@query("j11_source_hashes", f"WITH {SQL_LOG} SELECT e.id, e.example_id, sha256(e.evidence_quote) = sha256(substr(x.current, e.evidence_start + 1, e.evidence_end - e.evidence_start)) AS same FROM (SELECT DISTINCT id, example_id, evidence_quote, evidence_start, evidence_end FROM candidates WHERE evidence_start IS NOT NULL AND evidence_end IS NOT NULL AND evidence_quote IS NOT NULL) e JOIN extraction_examples x ON x.id = e.example_id")
def j11(spark, d):
    """Stored quotes against the source at their place, compared by hash."""
    texts = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), "current")
    rows = read(spark, d, "candidates").where("evidence_start is not null and evidence_end is not null and evidence_quote is not null").select("id", "example_id", "evidence_quote", "evidence_start", "evidence_end").distinct().join(texts, "example_id")
    there = F.substring("current", F.col("evidence_start") + 1, F.col("evidence_end") - F.col("evidence_start"))
    return rows.select("id", "example_id", (F.sha2("evidence_quote", 256) == F.sha2(there, 256)).alias("same"))


#: The window that valid times are held against.
ASKED = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("j12_window_overlaps", _FACTS + f", q AS (SELECT *, TIMESTAMP '{ASKED[0]}' AS a_lo, TIMESTAMP '{ASKED[0]}' AS a_hi, true AS a_one, TIMESTAMP '{ASKED[1]}' AS b_lo, TIMESTAMP '{ASKED[1]}' AS b_hi, true AS b_one FROM f) SELECT id, {_sql_lt('s', 'b')} AND {_sql_lt('a', 'e')} AS overlaps FROM q")
def j12(spark, d):
    """Whether each fact's validity meets the window: true, false or, where a bound is unknown, null."""
    a, b = (T.instant(F.lit(x).cast("timestamp_ntz")) for x in ASKED)
    return _facts(spark, d).select("id", T.overlaps3((F.col("start"), F.col("end")), (a, b)).alias("overlaps"))


def matched_spans(candidates, examples, share: float = 0.5):
    """(id, gold): every candidate span with the number of the expected span that it takes, null if it takes none.

    In the order (ord, id) a candidate takes the first free expected span of its type and example that it overlaps by
    ``share`` of the shorter of the two. An example with n such spans can give only n matches, so for each span the first n
    candidates that overlap it are enough to decide.
    """
    gold = examples.select(F.col("id").alias("example_id"), "current", F.size("expected").alias("most"), F.posexplode("expected").alias("gold", "q"))
    start = F.expr("instr(current, q.evidence_quote)") - 1
    gold = gold.where("length(q.evidence_quote) > 0").select("example_id", "most", "gold", F.col("q.memory_type").alias("memory_type"), start.alias("lo"), (start + F.length("q.evidence_quote")).alias("hi")).where("lo >= 0")
    said = candidates.where("evidence_start is not null and evidence_end is not null").select("id", "example_id", "ord", "memory_type", "evidence_start", "evidence_end").dropDuplicates(["id"])
    both = said.join(gold, ["example_id", "memory_type"])
    common = F.least("evidence_end", "hi") - F.greatest("evidence_start", "lo")
    shorter = F.least(F.col("evidence_end") - F.col("evidence_start"), F.col("hi") - F.col("lo"))
    both = both.where((shorter > 0) & (common >= share * shorter)).select("example_id", "most", "gold", "ord", "id")
    near = A.first_of_each(both, ["example_id", "gold"], [F.col("ord")], F.col("most"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken, used = {}, set()
        for name, gold_no in group.sort_values(["ord", "id", "gold"])[["id", "gold"]].itertuples(index=False):
            if name not in taken and gold_no not in used:
                taken[name] = gold_no
                used.add(gold_no)
        return pd.DataFrame({"id": list(taken), "gold": list(taken.values())}).astype({"id": object, "gold": "int32"})

    found = near.groupBy("example_id").applyInPandas(run, "id string, gold int")
    return said.select("id").join(found, "id", "left")


@query("j17_span_matches")
def j17(spark, d):
    return matched_spans(read(spark, d, "candidates"), read(spark, d, "extraction_examples"))


#: The share of the smaller fact's words from which two facts are of one matter.
OF_ONE = 0.30
_SQL_NEAR = f"""{SQL_MEMORIES}, ft AS (SELECT id, example_id, memory_type, ord, content, date_trunc('day', created_at) AS day, created_at, {fact_terms_sql("content")} AS ts FROM mem WHERE content IS NOT NULL),
nr AS (SELECT a.id AS old, b.id AS new, a.day AS day_a, b.day AS day_b, a.created_at AS at_a, b.created_at AS at_b, len(list_filter(a.ts, lambda t: list_contains(b.ts, t))) / least(len(a.ts), len(b.ts)) AS score FROM ft a JOIN ft b ON a.example_id = b.example_id AND a.id <> b.id AND len(a.ts) > 0 AND len(b.ts) > 0),
pr AS (SELECT * FROM nr WHERE score >= {OF_ONE})"""


def near_facts(spark, d):
    """(old, new, day_a, day_b, at_a, at_b, score): pairs of facts of one example that share enough words, both orders.

    Facts meet by the words that they share, not all with all.
    """
    rows = memories(spark, d).where("content is not null").select("id", "example_id", F.date_trunc("day", "created_at").alias("day"), F.col("created_at").alias("at"), fact_terms(F.col("content")).alias("ts"))
    words = rows.select("*", F.size("ts").alias("n"), F.explode("ts").alias("word")).drop("ts")
    a, b = (words.select("example_id", "word", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "day", "at", "n")]) for x in "ab")
    both = a.join(b, ["example_id", "word"]).where("id_a <> id_b").groupBy("id_a", "id_b", "day_a", "day_b", "at_a", "at_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    score = F.col("common") / F.least("n_a", "n_b")
    return both.select(F.col("id_a").alias("old"), F.col("id_b").alias("new"), "day_a", "day_b", "at_a", "at_b", score.alias("score")).where(F.col("score") >= OF_ONE)


@query("j26_conflicting_facts", f"WITH {_SQL_NEAR} SELECT old AS id_a, new AS id_b, round(score, 6) AS score FROM pr WHERE old < new AND day_a <> day_b")
def j26(spark, d):
    """Facts of one example that share enough words and were recorded on different days."""
    return near_facts(spark, d).where("old < new and day_a <> day_b").select(F.col("old").alias("id_a"), F.col("new").alias("id_b"), F.round("score", 6).alias("score"))


@query("j22_replaced_facts", f"WITH {_SQL_NEAR}, best AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY score DESC, at_a DESC, old) AS nth FROM pr WHERE at_a < at_b), one AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY at_b, new) AS mth FROM best WHERE nth = 1) SELECT new AS id, old AS replaces FROM one WHERE mth = 1")
def j22(spark, d):
    """The older fact that each fact replaces: the nearest; one that several would replace goes to the earliest of them."""
    older = near_facts(spark, d).where("at_a < at_b")
    best = older.groupBy("new", "at_b").agg(F.max(F.struct("score", "at_a", F.lit(0).alias("x"))).alias("top")).join(older, ["new", "at_b"]).where("score = top.score and at_a = top.at_a")
    best = best.groupBy("new", "at_b").agg(F.min("old").alias("old"))
    return best.groupBy("old").agg(F.min(F.struct("at_b", "new"))["new"].alias("id")).select("id", F.col("old").alias("replaces"))


# ---- lookups


@query("r14_snapshot_search", f"WITH {SQL_MEMORIES}, h AS (SELECT max(seq) // 2 AS half FROM log), s AS (SELECT id, round({_rel_sql('три снимка')}, 6) AS score FROM mem, h WHERE content IS NOT NULL AND cursor_seq <= half) SELECT id, score FROM s WHERE score > 0.01")
def r14(spark, d):
    """Facts that a snapshot at half of the log holds, by their relevance."""
    half = F.broadcast(read(spark, d, "event_log").agg(F.expr("max(seq) div 2").alias("half")))
    rows = memories(spark, d).where("content is not null").join(half, F.col("cursor_seq") <= F.col("half"))
    return rows.select("id", F.round(X.lexical_relevance("три снимка", F.col("content")), 6).alias("score")).where("score > 0.01")


@query("s08_usage_samples", f"WITH {SQL_LOG} SELECT seq, id, kind, {_SQL_TOKENS} AS tokens FROM log WHERE seq > (SELECT max(seq) // 3 FROM event_log) ORDER BY seq LIMIT 200")
def s08(spark, d):
    """A page of two hundred samples behind a cursor."""
    cursor = F.broadcast(read(spark, d, "event_log").agg(F.expr("max(seq) div 3").alias("cursor")))
    rows = log(spark, d).join(cursor, F.col("seq") > F.col("cursor")).orderBy("seq").limit(200)
    return rows.select("seq", "id", "kind", F.coalesce(X.token_estimate(F.col("content")), F.lit(0)).alias("tokens"))


# Ends of names of artifacts that are text.
TEXT_ENDS = ("py", "ts", "sql", "json", "toml", "md")
_SQL_SECRET = " OR ".join(f"regexp_matches(content, '{p}')" for _, p, _ in X.SECRET_RULES)


@query("s20_artifact_rules", f"WITH {SQL_LOG}, a AS (SELECT id, regexp_matches(lower(content), '[.]({'|'.join(TEXT_ENDS[:4])})$') AS textual, {_SQL_SECRET} AS secret FROM log WHERE kind = 'artifact' AND content IS NOT NULL) SELECT id, textual, CASE WHEN secret AND NOT textual THEN 'refused' WHEN secret THEN 'redacted' ELSE 'stored' END AS outcome FROM a")
def s20(spark, d):
    """Artifacts that are text are stored redacted, others that hold a secret are refused."""
    secret = F.lit(False)
    for _, pattern, _ in X.SECRET_RULES:
        secret = secret | F.col("content").rlike(pattern)
    rows = log(spark, d, "kind = 'artifact' and content is not null").select("id", F.lower("content").rlike(rf"\.({'|'.join(TEXT_ENDS[:4])})$").alias("textual"), secret.alias("secret"))
    return rows.select("id", "textual", F.when(F.col("secret") & ~F.col("textual"), "refused").when(F.col("secret"), "redacted").otherwise("stored").alias("outcome"))


@query("u03_ordered_distinct", f"WITH {SQL_LOG}, s AS (SELECT session_id, file, min((seq, n)) AS spot FROM (SELECT session_id, seq, unnest(files) AS file, generate_subscripts(files, 1) AS n FROM log WHERE session_id IS NOT NULL) GROUP BY 1, 2) SELECT session_id, file, row_number() OVER (PARTITION BY session_id ORDER BY spot) AS place FROM s")
def u03(spark, d):
    """The files of each session, each at its first place."""
    from pyspark.sql import Window

    rows = log(spark, d, "session_id is not null and size(files) > 0").select("session_id", "seq", F.posexplode("files").alias("n", "file"))
    first = rows.groupBy("session_id", "file").agg(F.min(F.struct("seq", "n")).alias("at"))
    return first.select("session_id", "file", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).alias("place"))


@query("v20_exact_sources", f"WITH {SQL_MEMORIES}, i AS (SELECT DISTINCT source_event_id AS ref FROM finalization_quarantine WHERE source_event_id IS NOT NULL UNION SELECT id FROM mem UNION SELECT example_id FROM mem), r AS (SELECT ref, 'event' AS form, l.seq, l.content FROM i JOIN log l ON l.id = i.ref UNION ALL SELECT ref, 'fact', l.seq, l.content FROM i JOIN mem m ON m.id = i.ref JOIN log l ON l.id = m.source_event_id UNION ALL SELECT ref, 'example', NULL, e.current FROM i JOIN extraction_examples e ON e.id = i.ref) SELECT ref, form, seq, md5(content) AS digest FROM r")
def v20(spark, d):
    """References of several forms with the source that each stands for: an event, a fact's event, an example's text."""
    facts, events = memories(spark, d).select("id", "example_id", "source_event_id"), log(spark, d).select("id", "seq", "content")
    refs = read(spark, d, "finalization_quarantine").select(F.col("source_event_id").alias("ref")).where("ref is not null")
    refs = refs.unionByName(facts.select(F.col("id").alias("ref"))).unionByName(facts.select(F.col("example_id").alias("ref"))).distinct()
    form = lambda rows, name: rows.select("ref", F.lit(name).alias("form"), "seq", F.md5("content").alias("digest"))
    direct = form(refs.join(events, F.col("ref") == F.col("id")), "event")
    through = form(refs.join(facts.select(F.col("id").alias("ref"), F.col("source_event_id").alias("id")), "ref").join(events, "id"), "fact")
    texts = read(spark, d, "extraction_examples").select(F.col("id").alias("ref"), F.col("current").alias("content"), F.lit(None).cast("bigint").alias("seq"))
    return direct.unionByName(through).unionByName(form(refs.join(texts, "ref"), "example"))


@query("w10_final_order", f"WITH {SQL_LOG}, s AS (SELECT id, created_at, round({_rel_sql(QUERY)} * 0.85 + {_SQL_FRESH} * 0.15, 6) AS score FROM log WHERE content IS NOT NULL) SELECT id, score FROM s ORDER BY score DESC, created_at DESC, id LIMIT 20")
def w10(spark, d):
    """The twenty best events by score, newer ones first among equals."""
    score = F.round(X.lexical_relevance(QUERY, F.col("content")) * 0.85 + _fresh() * 0.15, 6)
    return log(spark, d, "content is not null").select("id", "created_at", score.alias("score")).orderBy(F.desc("score"), F.desc("created_at"), "id").limit(20).select("id", "score")


#: What is older than this many days before the last record is old; how far a fact may lie back.
OLD_DAYS = 20


@query("g20_hygiene", f"WITH {SQL_MEMORIES}, n AS (SELECT max(created_at) AS now FROM mem), k AS (SELECT DISTINCT unnest(files) AS file FROM log), x AS (SELECT id AS example_id, unnest(files) AS file FROM extraction_examples), g AS (SELECT DISTINCT example_id FROM x WHERE file NOT IN (SELECT file FROM k)) SELECT m.id, CASE WHEN g.example_id IS NOT NULL THEN 'missing_file' ELSE 'too_old' END AS finding FROM mem m LEFT JOIN g USING (example_id), n WHERE g.example_id IS NOT NULL OR m.created_at < n.now - INTERVAL {OLD_DAYS} DAY")
def g20(spark, d):
    """Facts whose example names a file that the log does not know, else those that are old."""
    facts = memories(spark, d)
    known = log(spark, d, "size(files) > 0").select(F.explode("files").alias("file")).distinct()
    gone = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), F.explode("files").alias("file")).join(known, "file", "left_anti").select("example_id").distinct().withColumn("gone", F.lit(True))
    now = F.broadcast(facts.agg(F.max("created_at").alias("now")))
    rows = facts.join(gone, "example_id", "left").crossJoin(now)
    old = F.col("created_at") < F.col("now") - F.make_dt_interval(days=F.lit(OLD_DAYS))
    return rows.where(F.coalesce("gone", F.lit(False)) | old).select("id", F.when(F.col("gone"), "missing_file").otherwise("too_old").alias("finding"))


_SQL_CONTENT = "lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))"


@query("g14_consolidated", f"WITH {SQL_MEMORIES}, a AS (SELECT memory_type AS type, {_SQL_CONTENT} AS content, 0 AS turn, cursor_seq AS seq, id FROM mem WHERE content IS NOT NULL UNION ALL SELECT 'marker', {_SQL_CONTENT}, 1, seq, id FROM log WHERE kind = 'memory_block' AND content IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY type, content ORDER BY turn, seq, id) AS nth, count(*) OVER (PARTITION BY type, content) AS n FROM a) SELECT type, content, id, n FROM r WHERE nth = 1")
def g14(spark, d):
    """Structured facts and marked blocks, each type and content once, at its first record."""
    content = F.lower(F.trim(F.regexp_replace("content", r"\s+", " "))).alias("content")
    facts = memories(spark, d).where("content is not null").select(F.col("memory_type").alias("type"), content, F.lit(0).alias("turn"), F.col("cursor_seq").alias("seq"), "id")
    marks = log(spark, d, "kind = 'memory_block' and content is not null").select(F.lit("marker").alias("type"), content, F.lit(1).alias("turn"), "seq", "id")
    return facts.unionByName(marks).groupBy("type", "content").agg(F.min(F.struct("turn", "seq", "id"))["id"].alias("id"), F.count(F.lit(1)).alias("n"))


#: Of a check section: versions before the last ones, how far back, conflicts, and its room.
PRIOR, DEPTH, CONFLICTS, CHECK_TOKENS = 4, 2, 3, 600


@query(
    "pack09_check_material",
    f"""WITH {_SQL_NEAR}, fx AS (SELECT id, example_id, supersedes_id, {_SQL_TOKENS} AS tokens FROM mem), la AS (SELECT * FROM fx WHERE id NOT IN (SELECT supersedes_id FROM fx WHERE supersedes_id IS NOT NULL)),
o1 AS (SELECT b.example_id, b.id, b.tokens, 1 AS steps, b.supersedes_id FROM la JOIN fx b ON b.id = la.supersedes_id), o2 AS (SELECT b.example_id, b.id, b.tokens, 2 AS steps FROM o1 JOIN fx b ON b.id = o1.supersedes_id),
pv AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY steps, id) AS nth FROM (SELECT example_id, id, tokens, steps FROM o1 UNION ALL SELECT * FROM o2)),
cf AS (SELECT a.example_id, pr.old || ' / ' || pr.new AS id, a.tokens + b.tokens AS tokens, row_number() OVER (PARTITION BY a.example_id ORDER BY round(score, 6) DESC, old, new) AS nth FROM pr JOIN fx a ON a.id = pr.old JOIN fx b ON b.id = pr.new WHERE old < new AND day_a <> day_b),
al AS (SELECT example_id, 0 AS section, nth, id, tokens FROM pv WHERE nth <= {PRIOR} UNION ALL SELECT example_id, 1, nth, id, tokens FROM cf WHERE nth <= {CONFLICTS}),
sp AS (SELECT *, sum(greatest(tokens, 1)) OVER (PARTITION BY example_id ORDER BY section, nth, id) AS spent FROM al) SELECT example_id, section, id, CAST(spent AS BIGINT) AS spent FROM sp WHERE spent <= {CHECK_TOKENS}""",
)
def pack09(spark, d):
    """What an answer about an example is checked against: the versions before its last facts and its nearest conflicts, until the room is full."""
    facts = cut(memories(spark, d).select("id", "example_id", "supersedes_id", F.coalesce(X.token_estimate(F.col("content")), F.lit(0)).alias("tokens")))
    front, prior = facts.join(facts.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id")), "id", "left_anti"), None
    for steps in range(1, DEPTH + 1):
        front = front.select(F.col("supersedes_id").alias("id")).where("id is not null").join(facts, "id")
        each = front.select("example_id", "id", "tokens", F.lit(steps).alias("order"))
        prior = each if prior is None else prior.unionByName(each)
    prior = A.first_of_each(prior, ["example_id"], [F.col("order")], F.lit(PRIOR)).select("example_id", F.lit(0).alias("section"), F.col("order").cast("double").alias("order"), "id", "tokens")
    pairs = near_facts(spark, d).where("old < new and day_a <> day_b")
    sizes = lambda name, tokens: facts.select(F.col("id").alias(name), "example_id", F.col("tokens").alias(tokens))
    pairs = pairs.join(sizes("old", "t1"), "old").join(sizes("new", "t2").drop("example_id"), "new")
    clash = pairs.select("example_id", (-F.round("score", 6)).alias("order"), F.concat_ws(" / ", "old", "new").alias("id"), (F.col("t1") + F.col("t2")).alias("tokens"))
    clash = A.first_of_each(clash, ["example_id"], [F.col("order")], F.lit(CONFLICTS)).select("example_id", F.lit(1).alias("section"), "order", "id", "tokens")
    rows = prior.unionByName(clash).withColumn("tokens", F.greatest("tokens", F.lit(1)))
    return A.prefix_within(rows, ["example_id"], [F.col("section"), F.col("order")], "tokens", CHECK_TOKENS).select("example_id", "section", "id", "spent")
