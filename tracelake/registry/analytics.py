"""Joins, aggregates, windows and set operations over the log (j.., a.., w.., u..)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators import assembly as A
from tracelake.plans import ordered as O
from tracelake.registry import query
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, log, memories, read

_SQL_TOKENS = r"CASE WHEN content IS NULL OR length(content) = 0 THEN 0 ELSE CAST(greatest(ceil(strlen(content) / 3), ceil(len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) * CAST(1.35 AS DOUBLE)), 1) AS BIGINT) END"
_SQL_USE = SQL_LOG + f", u AS (SELECT seq, id, branch_id, session_id, kind AS operation, {_SQL_TOKENS} AS tokens, coalesce(strlen(content), 0) AS raw_bytes, created_at FROM log)"


def usage(spark, d):
    """One usage sample per event: its operation, token estimate and bytes."""
    bytes_ = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    return log(spark, d).select("seq", "id", "branch_id", "session_id", F.col("kind").alias("operation"), F.coalesce(X.token_estimate(F.col("content")), F.lit(0)).alias("tokens"), bytes_.alias("raw_bytes"), "created_at")


# ---- aggregates


@query("a01_usage_totals", f"WITH {_SQL_USE} SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, count(*) AS samples, CAST(sum(CASE WHEN operation = 'tool_output' THEN tokens ELSE 0 END) AS BIGINT) AS tool_tokens, round(sum(CASE WHEN operation = 'tool_output' THEN tokens ELSE 0 END) / sum(tokens), 6) AS tool_share FROM u")
def a01(spark, d):
    tool = F.when(F.col("operation") == "tool_output", F.col("tokens")).otherwise(0)
    return usage(spark, d).agg(F.sum("tokens").alias("tokens"), F.sum("raw_bytes").alias("raw_bytes"), F.count(F.lit(1)).alias("samples"), F.sum(tool).alias("tool_tokens"), F.round(F.sum(tool) / F.sum("tokens"), 6).alias("tool_share"))


@query("a02_by_operation", f"WITH {_SQL_USE} SELECT operation, count(*) AS samples, CAST(sum(tokens) AS BIGINT) AS tokens FROM u GROUP BY 1")
def a02(spark, d):
    return usage(spark, d).groupBy("operation").agg(F.count(F.lit(1)).alias("samples"), F.sum("tokens").alias("tokens"))


@query("a03_index_percentiles", f"WITH {_SQL_USE}, r AS (SELECT operation, tokens, row_number() OVER (PARTITION BY operation ORDER BY tokens) AS place, count(*) OVER (PARTITION BY operation) AS n FROM u) SELECT operation, max(CASE WHEN place = n // 2 + 1 THEN tokens END) AS p50, max(CASE WHEN place = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1 THEN tokens END) AS p95 FROM r GROUP BY 1")
def a03(spark, d):
    """The value at index n div 2, and at int(.95 n), of the sorted values: from counts per value, without a sort of all rows."""
    per = usage(spark, d).groupBy("operation", "tokens").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("operation").orderBy("tokens")
    per = per.withColumn("through", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("operation")))

    def at(place):
        return F.max(F.when((F.col("through") - F.col("c") < place) & (place <= F.col("through")), F.col("tokens")))

    return per.groupBy("operation").agg(at(F.expr("n div 2") + 1).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)) + 1).alias("p95"))


@query("a04_nearest_rank", f"WITH {_SQL_USE} SELECT operation, quantile_disc(tokens, 0.9) AS p90 FROM u GROUP BY 1")
def a04(spark, d):
    return usage(spark, d).groupBy("operation").agg(F.expr("percentile_disc(0.9) within group (order by tokens)").cast("bigint").alias("p90"))


@query("a05_interpolated", f"WITH {_SQL_USE} SELECT operation, round(quantile_cont(tokens, 0.95), 6) AS p95 FROM u GROUP BY 1")
def a05(spark, d):
    return usage(spark, d).groupBy("operation").agg(F.round(F.percentile("tokens", 0.95), 6).alias("p95"))


@query("a06_context_totals", f"WITH {_SQL_USE}, c AS (SELECT branch_id, session_id, seq, sum(tokens) OVER (PARTITION BY branch_id, session_id ORDER BY seq) AS cumulative FROM u WHERE session_id IS NOT NULL), l AS (SELECT branch_id, session_id, arg_max(cumulative, seq) AS last FROM c GROUP BY 1, 2) SELECT branch_id, CAST(sum(last) AS BIGINT) AS cumulative, count(*) AS sessions FROM l GROUP BY 1")
def a06(spark, d):
    """The last running total of each session, summed over the sessions of a branch."""
    rows = usage(spark, d).where("session_id is not null").select("branch_id", "session_id", "seq", "tokens")
    running = O.with_running_sum(rows, ["branch_id", "session_id"], "seq", F.col("tokens"), "cumulative")
    last = running.groupBy("branch_id", "session_id").agg(F.max_by("cumulative", "seq").alias("last"))
    return last.groupBy("branch_id").agg(F.sum("last").alias("cumulative"), F.count(F.lit(1)).alias("sessions"))


@query("a08_extraction_status", f"WITH {SQL_MEMORIES} SELECT initial_status, count(*) AS n, count(DISTINCT run_id) AS runs, max(epoch_us(created_at)) AS newest_us, min(epoch_us(created_at)) AS oldest_us FROM mem GROUP BY 1")
def a08(spark, d):
    us = F.expr("unix_micros(cast(created_at as timestamp))")
    return memories(spark, d).groupBy("initial_status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"), F.max(us).alias("newest_us"), F.min(us).alias("oldest_us"))


@query("a09_storage_breakdown", "SELECT 'events' AS class, CAST(sum(coalesce(strlen(content), 0) + coalesce(strlen(payload_json), 0)) AS BIGINT) AS bytes FROM event_log UNION ALL SELECT 'quarantine', CAST(sum(coalesce(strlen(raw_content), 0)) AS BIGINT) FROM finalization_quarantine UNION ALL SELECT 'candidates', CAST(sum(coalesce(strlen(normalized_content), 0) + coalesce(strlen(evidence_quote), 0)) AS BIGINT) FROM candidates")
def a09(spark, d):
    def size(table, name, *columns):
        total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
        return read(spark, d, table).agg(F.sum(total.cast("bigint")).alias("bytes")).select(F.lit(name).alias("class"), "bytes")

    return size("event_log", "events", "content", "payload_json").unionByName(size("finalization_quarantine", "quarantine", "raw_content")).unionByName(size("candidates", "candidates", "normalized_content", "evidence_quote"))


@query("a10_operation_summary", f"WITH {SQL_LOG} SELECT session_id, arg_min(kind, seq) AS first_kind, arg_max(kind, seq) AS last_kind, count(*) AS n, max(seq) AS last_seq FROM log WHERE session_id IS NOT NULL GROUP BY 1")
def a10(spark, d):
    return log(spark, d, "session_id is not null").groupBy("session_id").agg(F.min_by("kind", "seq").alias("first_kind"), F.max_by("kind", "seq").alias("last_kind"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query("a11_finalization_counters", "SELECT coalesce(reason_code, 'none') AS reason, count(DISTINCT id) AS records, count(DISTINCT source_event_id) AS sources FROM finalization_quarantine GROUP BY 1")
def a11(spark, d):
    return read(spark, d, "finalization_quarantine").groupBy(F.coalesce("reason_code", F.lit("none")).alias("reason")).agg(F.count_distinct("id").alias("records"), F.count_distinct("source_event_id").alias("sources"))


_SQL_MATCH = "g AS (SELECT DISTINCT e.id AS example_id, q.memory_type AS memory_type, q.evidence_quote AS quote FROM (SELECT id, unnest(expected) AS q FROM extraction_examples) e), p AS (SELECT DISTINCT example_id, memory_type, evidence_quote AS quote FROM candidates WHERE evidence_quote IS NOT NULL), m AS (SELECT coalesce(g.memory_type, p.memory_type) AS memory_type, g.example_id IS NOT NULL AS gold, p.example_id IS NOT NULL AS said FROM g FULL OUTER JOIN p ON g.example_id = p.example_id AND g.memory_type = p.memory_type AND g.quote = p.quote)"


def _matched(spark, d):
    gold = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), F.explode("expected").alias("q")).select("example_id", "q.memory_type", F.col("q.evidence_quote").alias("quote")).distinct().withColumn("gold", F.lit(True))
    said = read(spark, d, "candidates").where("evidence_quote is not null").select("example_id", "memory_type", F.col("evidence_quote").alias("quote")).distinct().withColumn("said", F.lit(True))
    both = gold.join(said, ["example_id", "memory_type", "quote"], "full_outer")
    return both.select("memory_type", F.coalesce("gold", F.lit(False)).alias("gold"), F.coalesce("said", F.lit(False)).alias("said"))


@query("a12_precision_recall", f"WITH {_SQL_MATCH}, c AS (SELECT coalesce(memory_type, 'all') AS memory_type, count(CASE WHEN gold AND said THEN 1 END) AS hit, count(CASE WHEN said THEN 1 END) AS said, count(CASE WHEN gold THEN 1 END) AS gold FROM m GROUP BY GROUPING SETS ((memory_type), ())) SELECT memory_type, round(CASE WHEN said = 0 THEN 1.0 ELSE hit / said END, 6) AS precision, round(CASE WHEN gold = 0 THEN 1.0 ELSE hit / gold END, 6) AS recall FROM c")
def a12(spark, d):
    """Precision and recall per type and over all; an empty denominator counts as 1."""
    rolled = _matched(spark, d).rollup("memory_type").agg(F.count_if(F.col("gold") & F.col("said")).alias("hit"), F.count_if("said").alias("said"), F.count_if("gold").alias("gold"))

    def ratio(base):
        return F.when(F.col(base) == 0, 1.0).otherwise(F.round(F.col("hit") / F.col(base), 6))

    return rolled.select(F.coalesce("memory_type", F.lit("all")).alias("memory_type"), ratio("said").alias("precision"), ratio("gold").alias("recall"))


# The least precision and recall, and the greatest gap between languages, with which a gate is passed.
GATE_PRECISION, GATE_RECALL, GATE_GAP = 0.90, 0.70, 0.10


@query(
    "a13_gate",
    f"""WITH g AS (SELECT DISTINCT e.id AS example_id, coalesce(lower(trim(e.lang)), 'none') AS lang, q.memory_type AS memory_type, q.evidence_quote AS quote FROM (SELECT id, lang, unnest(expected) AS q FROM extraction_examples) e),
p AS (SELECT DISTINCT c.example_id, coalesce(lower(trim(e.lang)), 'none') AS lang, c.memory_type, c.evidence_quote AS quote FROM candidates c JOIN extraction_examples e ON e.id = c.example_id WHERE c.evidence_quote IS NOT NULL),
m AS (SELECT coalesce(g.lang, p.lang) AS lang, g.example_id IS NOT NULL AS gold, p.example_id IS NOT NULL AS said FROM g FULL OUTER JOIN p ON g.example_id = p.example_id AND g.memory_type = p.memory_type AND g.quote = p.quote),
r AS (SELECT lang, count(CASE WHEN said THEN 1 END) AS n_said, count(CASE WHEN gold THEN 1 END) AS n_gold, count(CASE WHEN gold AND said THEN 1 END) AS hit FROM m GROUP BY 1),
s AS (SELECT lang, CASE WHEN n_said = 0 THEN 0.0 ELSE hit / n_said END AS precision, CASE WHEN n_gold = 0 THEN 0.0 ELSE hit / n_gold END AS recall, n_said, n_gold, hit FROM r)
SELECT count(*) AS languages, round(sum(hit) / greatest(sum(n_said), 1), 6) AS precision, round(sum(hit) / greatest(sum(n_gold), 1), 6) AS recall, round(max(precision) - min(precision), 6) AS precision_gap, round(max(recall) - min(recall), 6) AS recall_gap,
  sum(hit) / greatest(sum(n_said), 1) >= {GATE_PRECISION} AND sum(hit) / greatest(sum(n_gold), 1) >= {GATE_RECALL} AND max(precision) - min(precision) <= {GATE_GAP} AS passed FROM s""",
)
def a13(spark, d):
    """The gate over all languages: precision and recall, their gaps between languages, and whether it is passed; an empty denominator counts as 0."""
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang")
    examples = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), lang, "expected")
    gold = examples.select("example_id", "lang", F.explode("expected").alias("q")).select("example_id", "lang", "q.memory_type", F.col("q.evidence_quote").alias("quote")).distinct().withColumn("gold", F.lit(True))
    said = read(spark, d, "candidates").where("evidence_quote is not null").select("example_id", "memory_type", F.col("evidence_quote").alias("quote")).distinct().join(examples.select("example_id", F.col("lang").alias("said_lang")), "example_id").withColumn("said", F.lit(True))
    both = gold.join(said, ["example_id", "memory_type", "quote"], "full_outer").select(F.coalesce("lang", "said_lang").alias("lang"), F.coalesce("gold", F.lit(False)).alias("gold"), F.coalesce("said", F.lit(False)).alias("said"))
    per = both.groupBy("lang").agg(F.count_if("said").alias("n_said"), F.count_if("gold").alias("n_gold"), F.count_if(F.col("gold") & F.col("said")).alias("hit"))
    ratio = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.col("hit") / F.col(n))
    per = per.withColumn("p", ratio("n_said")).withColumn("r", ratio("n_gold"))
    precision, recall = F.sum("hit") / F.greatest(F.sum("n_said"), F.lit(1)), F.sum("hit") / F.greatest(F.sum("n_gold"), F.lit(1))
    gap = F.max("p") - F.min("p")
    passed = (precision >= GATE_PRECISION) & (recall >= GATE_RECALL) & (gap <= GATE_GAP)
    return per.agg(F.count(F.lit(1)).alias("languages"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(gap, 6).alias("precision_gap"), F.round(F.max("r") - F.min("r"), 6).alias("recall_gap"), passed.alias("passed"))


_SQL_ROWS = "r AS (SELECT DISTINCT question_id, question_type, original_correct, retrieval_hit, gold_coverage, context_tokens FROM rejudge_rows)"


@query("a14_report", f"WITH {_SQL_ROWS} SELECT coalesce(question_type, 'overall') AS question_type, count(*) AS n, round(avg(CAST(original_correct AS INT)), 6) AS accuracy, round(avg(CAST(retrieval_hit AS INT)), 6) AS recall, round(avg(gold_coverage), 6) AS coverage, CAST(sum(context_tokens) AS BIGINT) AS tokens FROM r GROUP BY GROUPING SETS ((question_type), ())")
def a14(spark, d):
    rows = read(spark, d, "rejudge_rows").select("question_id", "question_type", "original_correct", "retrieval_hit", "gold_coverage", "context_tokens").distinct()
    rolled = rows.rollup("question_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("original_correct").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("retrieval_hit").cast("int")), 6).alias("recall"), F.round(F.avg("gold_coverage"), 6).alias("coverage"), F.sum("context_tokens").alias("tokens"))
    return rolled.withColumn("question_type", F.coalesce("question_type", F.lit("overall")))


@query("a15_census", f"WITH {_SQL_ROWS} SELECT question_type, CASE WHEN NOT retrieval_hit THEN 'retrieval' WHEN gold_coverage < 1 THEN 'packing' ELSE 'passage' END AS stage, count(CASE WHEN original_correct THEN 1 END) AS right_, count(CASE WHEN NOT original_correct THEN 1 END) AS wrong FROM r GROUP BY 1, 2")
def a15(spark, d):
    rows = read(spark, d, "rejudge_rows").select("question_id", "question_type", "original_correct", "retrieval_hit", "gold_coverage", "context_tokens").distinct()
    stage = F.when(~F.col("retrieval_hit"), "retrieval").when(F.col("gold_coverage") < 1, "packing").otherwise("passage")
    return rows.groupBy("question_type", stage.alias("stage")).agg(F.count_if("original_correct").alias("right_"), F.count_if(~F.col("original_correct")).alias("wrong"))


@query("a18_conflicts", f"WITH {SQL_MEMORIES} SELECT example_id, memory_type, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us, count(DISTINCT lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS variants FROM mem GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) > 1")
def a18(spark, d):
    """Facts of one example, type and validity whose contents differ by more than case and blanks."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    key = F.lower(F.trim(F.regexp_replace("content", r"\s+", " ")))
    return memories(spark, d).groupBy("example_id", "memory_type", us("valid_from").alias("from_us"), us("valid_to").alias("to_us")).agg(F.count_distinct(key).alias("variants")).where("variants > 1")


#: Postings of a term lie in so many blocks, by a digest of the id, so that no term is gathered in one row.
POSTING_BLOCKS = 4096


@query("a19_inverted_index", f"WITH {SQL_MEMORIES}, t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM mem) SELECT term, substr(md5(id), 1, 3) AS block, string_agg(id, ',' ORDER BY id) AS ids FROM t GROUP BY 1, 2")
def a19(spark, d):
    """The sorted ids of each term, in blocks."""
    terms = memories(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"))
    return terms.groupBy("term", F.substring(F.md5("id"), 1, 3).alias("block")).agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))


@query("a22_replay_tail", f"WITH {SQL_LOG} SELECT branch_id, CAST(sum(coalesce(strlen(content), 0)) AS BIGINT) AS bytes FROM log WHERE seq > (SELECT max(seq) * 3 // 4 FROM event_log) GROUP BY 1")
def a22(spark, d):
    cursor = read(spark, d, "event_log").agg(F.expr("max(seq) * 3 div 4").alias("cursor"))
    tail = log(spark, d).join(F.broadcast(cursor), F.col("seq") > F.col("cursor"))
    return tail.groupBy("branch_id").agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")).alias("bytes"))


@query("a24_grouping_sets", f"WITH {SQL_LOG} SELECT kind, origin_channel, count(*) AS n FROM log GROUP BY CUBE (kind, origin_channel)")
def a24(spark, d):
    return log(spark, d).cube("kind", "origin_channel").agg(F.count(F.lit(1)).alias("n"))


@query("a25_rejudged", "WITH r AS (SELECT DISTINCT question_id, question_type, original_correct FROM rejudge_rows WHERE original_correct IS NOT NULL), n AS (SELECT question_id, lower(trim(rejudged)) IN ('true', 't', '1', 'yes', 'correct') AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, vote_id DESC) AS nth FROM rejudge_labels WHERE rejudged IS NOT NULL) WHERE nth = 1) SELECT question_type, count(*) AS n, count(CASE WHEN fresh AND NOT original_correct THEN 1 END) AS flipped_up, count(CASE WHEN NOT fresh AND original_correct THEN 1 END) AS flipped_down FROM r JOIN n USING (question_id) GROUP BY 1")
def a25(spark, d):
    old = read(spark, d, "rejudge_rows").where("original_correct is not null").select("question_id", "question_type", "original_correct").distinct()
    new = read(spark, d, "rejudge_labels").where("rejudged is not null").groupBy("question_id").agg(F.max_by("rejudged", F.struct("created_at", "vote_id")).alias("last"))
    fresh = F.lower(F.trim("last")).isin("true", "t", "1", "yes", "correct")
    both = old.join(new, "question_id").withColumn("fresh", fresh)
    return both.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fresh") & ~F.col("original_correct")).alias("flipped_up"), F.count_if(~F.col("fresh") & F.col("original_correct")).alias("flipped_down"))


@query("a26_corpus_checks", "SELECT id, len(expected) AS n_quotes, len(list_filter(expected, lambda q: contains(current, q.evidence_quote))) AS n_found FROM extraction_examples")
def a26(spark, d):
    found = F.size(F.filter("expected", lambda q: F.contains(F.col("current"), q["evidence_quote"])))
    return read(spark, d, "extraction_examples").select("id", F.size("expected").alias("n_quotes"), found.alias("n_found"))


@query("a27_false_positives", "WITH g AS (SELECT id AS example_id, lang, len(expected) AS n, list_transform(expected, lambda q: q.evidence_quote) AS quotes, list_transform(expected, lambda q: q.memory_type) AS types, adversarial FROM extraction_examples), c AS (SELECT DISTINCT id, example_id, memory_type, evidence_quote FROM candidates), k AS (SELECT g.lang, CASE WHEN list_contains(quotes, evidence_quote) AND list_contains(types, memory_type) THEN 'match' WHEN list_contains(quotes, evidence_quote) THEN 'mistyped' WHEN adversarial THEN 'adversarial_span' WHEN n = 0 THEN 'extra_on_empty' ELSE 'extra_span' END AS kind FROM c JOIN g USING (example_id)) SELECT lang, kind, count(*) AS n FROM k GROUP BY 1, 2")
def a27(spark, d):
    gold = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), "lang", F.size("expected").alias("n_gold"), F.transform("expected", lambda q: q["evidence_quote"]).alias("quotes"), F.transform("expected", lambda q: q["memory_type"]).alias("types"), "adversarial")
    said = read(spark, d, "candidates").select("id", "example_id", "memory_type", "evidence_quote").distinct()
    quoted, typed = F.coalesce(F.array_contains("quotes", F.col("evidence_quote")), F.lit(False)), F.array_contains("types", F.col("memory_type"))
    kind = F.when(quoted & typed, "match").when(quoted, "mistyped").when(F.col("adversarial"), "adversarial_span").when(F.col("n_gold") == 0, "extra_on_empty").otherwise("extra_span")
    return said.join(gold, "example_id").groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("a28_evaluation_rates", "SELECT round((count(*) - count(DISTINCT id)) / count(*), 6) AS duplicate_rate, round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence, round(count(CASE WHEN initial_status = 'rejected' THEN 1 END) / count(*), 6) AS rejected_rate FROM candidates")
def a28(spark, d):
    n = F.count(F.lit(1))
    return read(spark, d, "candidates").agg(F.round((n - F.count_distinct("id")) / n, 6).alias("duplicate_rate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.round(F.count_if(F.col("initial_status") == "rejected") / n, 6).alias("rejected_rate"))


# ---- windows


@query("w01_latest_by_position", f"WITH {SQL_LOG}, r AS (SELECT session_id, kind AS status, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM log WHERE session_id IS NOT NULL) SELECT session_id, status, seq, back FROM r WHERE back <= 3")
def w01(spark, d):
    """The last three records of each session by position, not by time."""
    rows = log(spark, d, "session_id is not null").select("session_id", F.col("kind").alias("status"), "seq")
    return O.last_of_each(rows, ["session_id"], "seq", 3)


@query("w02_latest_version", f"WITH {SQL_MEMORIES} SELECT example_id, memory_type, arg_max(id, ord) AS id, count(*) AS version FROM mem GROUP BY 1, 2")
def w02(spark, d):
    return memories(spark, d).groupBy("example_id", "memory_type").agg(F.max_by("id", "ord").alias("id"), F.count(F.lit(1)).alias("version"))


def running_tokens(spark, d):
    """(session_id, id, tokens, cumulative): the running sum per session."""
    rows = usage(spark, d).where("session_id is not null").select("session_id", "id", "seq", "tokens")
    return O.with_running_sum(rows, ["session_id"], "seq", F.col("tokens"), "cumulative")


@query("w03_running_total", f"WITH {_SQL_USE} SELECT id, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS cumulative FROM u WHERE session_id IS NOT NULL")
def w03(spark, d):
    return running_tokens(spark, d).select("id", "cumulative")


@query("w04_threshold_crossings", f"WITH {_SQL_USE}, c AS (SELECT id, session_id, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY seq) AS cum FROM u WHERE session_id IS NOT NULL) SELECT id, session_id FROM c WHERE cum - tokens < 300 AND cum >= 300")
def w04(spark, d):
    return running_tokens(spark, d).where("cumulative - tokens < 300 and cumulative >= 300").select("id", "session_id")


@query("w12_line_context", rf"WITH {SQL_LOG}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM log WHERE kind = 'tool_output' AND content IS NOT NULL), f AS (SELECT *, max(CASE WHEN regexp_matches(line, '{X.FAILURE}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l) SELECT id, n, line FROM f WHERE near = 1")
def w12(spark, d):
    """Lines within two lines of a failure."""
    lines = log(spark, d, "kind = 'tool_output' and content is not null").select("id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    near = F.max(F.col("line").rlike(X.FAILURE).cast("int")).over(Window.partitionBy("id").orderBy("n").rowsBetween(-2, 2))
    return lines.withColumn("near", near).where("near = 1").select("id", (F.col("n") + 1).alias("n"), "line")


@query("w13_repeat_collapse", f"WITH {SQL_LOG}, s AS (SELECT session_id, seq, content, CASE WHEN content = lag(content) OVER (PARTITION BY session_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM log WHERE kind = 'tool_call' AND session_id IS NOT NULL AND content IS NOT NULL), g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY seq) AS island FROM s) SELECT session_id, content, min(seq) AS first_seq, count(*) AS times FROM g GROUP BY session_id, island, content")
def w13(spark, d):
    """Consecutive equal tool calls of a session as one row with a count."""
    rows = log(spark, d, "kind = 'tool_call' and session_id is not null and content is not null").select("session_id", "seq", "content")
    rows = O.with_previous(rows, ["session_id"], "seq", "content", "before")
    islands = O.with_running_sum(rows, ["session_id"], "seq", F.when(F.col("content") == F.col("before"), 0).otherwise(1), "island")
    return islands.groupBy("session_id", "island", "content").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("times")).drop("island")


@query("w14_head_and_tail", f"WITH {SQL_LOG}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n, len(string_split(content, chr(10))) AS size FROM log WHERE kind = 'tool_output' AND content IS NOT NULL) SELECT id, n, line FROM l WHERE n <= 3 OR n > size - 2 OR regexp_matches(line, '{X.FAILURE}') OR regexp_matches(line, '{X.WARNING}')")
def w14(spark, d):
    """The head, the salient lines and the tail of each output."""
    rows = log(spark, d, "kind = 'tool_output' and content is not null").select("id", F.split("content", "\n").alias("lines"))
    lines = rows.select("id", F.size("lines").alias("size"), F.posexplode("lines").alias("n", "line")).withColumn("n", F.col("n") + 1)
    return lines.where((F.col("n") <= 3) | (F.col("n") > F.col("size") - 2) | F.col("line").rlike(X.FAILURE) | F.col("line").rlike(X.WARNING)).select("id", "n", "line")


@query("w15_rate_limit_gaps", f"WITH {SQL_LOG}, g AS (SELECT id, seq - lag(seq) OVER (PARTITION BY branch_id ORDER BY seq) AS gap FROM log WHERE kind = 'memory_block') SELECT id, gap, coalesce(gap >= 20, true) AS allowed FROM g")
def w15(spark, d):
    rows = log(spark, d, "kind = 'memory_block'").select("branch_id", "id", "seq")
    rows = O.with_previous(rows, ["branch_id"], "seq", "seq", "before").withColumn("gap", F.col("seq") - F.col("before"))
    return rows.select("id", "gap", F.coalesce(F.col("gap") >= 20, F.lit(True)).alias("allowed"))


@query("w17_fanout_cap", f"WITH {SQL_MEMORIES}, r AS (SELECT memory_type, id, row_number() OVER (PARTITION BY memory_type ORDER BY confidence DESC, id) AS place FROM mem) SELECT memory_type, id FROM r WHERE place <= 200")
def w17(spark, d):
    """The two hundred surest facts of each type: those of salted parts first, then of what they leave."""
    return A.first_of_each(memories(spark, d).select("memory_type", "id", "confidence"), ["memory_type"], [F.desc("confidence")], F.lit(200)).select("memory_type", "id")


@query("w18_newest", f"WITH {SQL_MEMORIES} SELECT id FROM mem ORDER BY created_at DESC, id LIMIT 2000")
def w18(spark, d):
    return memories(spark, d).orderBy(F.desc("created_at"), "id").limit(2000).select("id")


# ---- joins and sets


@query("j05_pending", f"WITH {SQL_LOG} SELECT l.id FROM log l LEFT JOIN (SELECT DISTINCT source_event_id FROM finalization_quarantine) q ON q.source_event_id = l.id WHERE l.kind = 'message' AND l.role = 'assistant' AND q.source_event_id IS NULL AND l.content LIKE '%?'")
def j05(spark, d):
    done = read(spark, d, "finalization_quarantine").select(F.col("source_event_id").alias("id")).distinct()
    return log(spark, d, "kind = 'message' and role = 'assistant' and content like '%?'").join(done, "id", "left_anti").select("id")


@query("j06_candidate_chain", f"WITH {SQL_MEMORIES} SELECT m.run_id, count(*) AS n, count(DISTINCT l.session_id) AS sessions FROM mem m JOIN extraction_examples e ON e.id = m.example_id JOIN log l ON l.id = m.source_event_id GROUP BY 1")
def j06(spark, d):
    examples = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"))
    events = log(spark, d).select(F.col("id").alias("source_event_id"), "session_id")
    chain = memories(spark, d).join(examples, "example_id").join(events, "source_event_id")
    return chain.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"))


@query("j14_call_result_pairs", f"WITH {SQL_LOG}, c AS (SELECT json_extract_string(payload_json, '$.call_id') AS call_id, * FROM log WHERE kind IN ('tool_call', 'tool_output')) SELECT a.id AS call, b.id AS result, b.seq - a.seq AS distance FROM c a JOIN c b ON a.call_id = b.call_id AND a.kind = 'tool_call' AND b.kind = 'tool_output'")
def j14(spark, d):
    """Calls and outputs of one call id; ``g01_call_groups`` has those without one too."""
    rows = log(spark, d, "kind in ('tool_call', 'tool_output')").withColumn("call_id", F.get_json_object("payload_json", "$.call_id"))
    calls = rows.where("kind = 'tool_call'").select("call_id", F.col("id").alias("call"), F.col("seq").alias("from_seq"))
    results = rows.where("kind = 'tool_output'").select("call_id", F.col("id").alias("result"), "seq")
    return calls.join(results, "call_id").select("call", "result", (F.col("seq") - F.col("from_seq")).alias("distance"))


@query("j15_first_evidence", f"WITH {SQL_LOG} SELECT id, next_output FROM (SELECT id, kind, min(CASE WHEN kind = 'tool_output' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_output FROM log WHERE session_id IS NOT NULL) WHERE kind = 'tool_call'")
def j15(spark, d):
    """The first tool result after each call of a session, by sorts instead of a range join."""
    rows = log(spark, d, "session_id is not null").select("session_id", "id", "kind", "seq")
    return O.with_next_where(rows, ["session_id"], "seq", F.col("kind") == "tool_output", "next_output").where("kind = 'tool_call'").select("id", "next_output")


@query("j16_gold_matches", f"WITH {_SQL_MATCH} SELECT gold, said, count(*) AS n FROM m GROUP BY 1, 2")
def j16(spark, d):
    return _matched(spark, d).groupBy("gold", "said").agg(F.count(F.lit(1)).alias("n"))


@query("j25_fingerprint_diff", f"WITH {SQL_LOG}, o AS (SELECT unnest(files) AS file, session_id FROM log WHERE created_at < TIMESTAMP '2024-01-15 00:00:00'), n AS (SELECT unnest(files) AS file, session_id FROM log WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'), a AS (SELECT file, count(*) AS c FROM o GROUP BY 1), b AS (SELECT file, count(*) AS c FROM n GROUP BY 1) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'removed' WHEN a.c = b.c THEN 'same' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.file = b.file")
def j25(spark, d):
    files = log(spark, d).select(F.explode("files").alias("file"), (F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("old"))
    per = files.groupBy("file").agg(F.count_if("old").alias("a"), F.count_if(~F.col("old")).alias("b"))
    return per.select("file", F.when(F.col("a") == 0, "added").when(F.col("b") == 0, "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("change"))


@query("j27_known_content", f"WITH {SQL_MEMORIES} SELECT id, arg_min(first_id, 1) AS known_as FROM (SELECT id, first_value(id) OVER (PARTITION BY lower(content) ORDER BY created_at, id) AS first_id FROM mem) WHERE id <> first_id GROUP BY 1")
def j27(spark, d):
    """Facts whose content an earlier fact already holds."""
    rows = memories(spark, d).select("id", "created_at", F.lower("content").alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct("created_at", "id"))["id"].alias("known_as"))
    return rows.join(first, "key").where("id <> known_as").select("id", "known_as")


@query("u05_missing_quotes", "SELECT id, memory_type FROM (SELECT id, q.memory_type AS memory_type, q.evidence_quote AS quote FROM (SELECT id, unnest(expected) AS q FROM extraction_examples) EXCEPT ALL SELECT example_id, memory_type, evidence_quote FROM candidates)")
def u05(spark, d):
    gold = read(spark, d, "extraction_examples").select("id", F.explode("expected").alias("q")).select("id", "q.memory_type", "q.evidence_quote")
    said = read(spark, d, "candidates").select(F.col("example_id").alias("id"), "memory_type", "evidence_quote")
    return gold.exceptAll(said).select("id", "memory_type")


@query("u07_intersection", "SELECT example_id AS id FROM candidates INTERSECT SELECT id FROM extraction_examples WHERE adversarial")
def u07(spark, d):
    return read(spark, d, "candidates").select(F.col("example_id").alias("id")).intersect(read(spark, d, "extraction_examples").where("adversarial").select("id"))
