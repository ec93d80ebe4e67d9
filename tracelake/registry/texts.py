"""Text, JSON and hash functions over events, facts and documents (f..)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.registry import query
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, log, memories, read

QUERY = "the retrieval order of the packet"

_TERM = r"[\p{L}\p{N}_./:-]+"


def terms_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '{_TERM}'), lambda t: length(t) > 1))"


@query("f01_terms", f"SELECT doc_id, len({terms_sql('text')}) AS n_terms FROM documents")
def f01(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(X.terms(F.col("text"))).alias("n_terms"))


_WANTED = "['" + "', '".join(dict.fromkeys(QUERY.split())) + "']"
_OWN = terms_sql('content')


@query(
    "f03_lexical_relevance",
    f"""WITH {SQL_LOG}, t AS (SELECT id, lower(content) AS low, {_OWN} AS own FROM log WHERE content IS NOT NULL), o AS (SELECT *, len(list_filter({_WANTED}, lambda x: list_contains(own, x))) AS n FROM t)
SELECT id, round(least(1.0, 0.7 * n / {len(set(QUERY.split()))} + 0.15 * sqrt(n / greatest(len(own), 1)) + CASE WHEN contains(low, '{QUERY}') THEN 0.15 ELSE 0 END), 6) AS score FROM o""",
)
def f03(spark, d):
    return log(spark, d, "content is not null").select("id", F.round(X.lexical_relevance(QUERY, F.col("content")), 6).alias("score"))


@query("f04_freshness", f"WITH {SQL_LOG} SELECT id, round(exp(-ln(2) * greatest((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(created_at)) / 86400000000.0, 0) / 30.0), 6) AS freshness FROM log")
def f04(spark, d):
    age = (F.expr("unix_micros(timestamp'2024-02-01 00:00:00Z')") - F.expr("unix_micros(cast(created_at as timestamp))")) / 86400000000.0
    return log(spark, d).select("id", F.round(X.freshness(age, 30.0), 6).alias("freshness"))


@query("f05_exact_identifiers")
def f05(spark, d):
    found = X.exact_identifiers(F.col("content"))
    return log(spark, d, F.size(found) > 0).select("id", F.array_join(found, " ").alias("identifiers"))


_ID = r"(?:evt|mem|op|task|call|run|ex)_[0-9a-z_]+"


@query("f06_holds_identifiers", f"WITH {SQL_LOG}, q AS (SELECT DISTINCT id, source_event_id, raw_content FROM finalization_quarantine), w AS (SELECT q.id, list_distinct(regexp_extract_all(lower(concat_ws(' ', q.source_event_id, q.raw_content)), '{_ID}')) AS ids, lower(concat_ws(chr(10), l.id, l.content, l.payload_json)) AS hay FROM q JOIN log l ON l.id = q.source_event_id) SELECT id, len(ids) AS n_ids, len(list_filter(ids, lambda x: NOT contains(hay, x))) = 0 AS held FROM w")
def f06(spark, d):
    """Whether all identifiers of a quarantined record stand in the event that it comes from, whatever their case."""
    rows = read(spark, d, "finalization_quarantine").select(F.col("id").alias("record"), F.col("source_event_id").alias("id"), "raw_content").distinct().join(log(spark, d).select("id", "content", "payload_json"), "id")
    ids = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "id", "raw_content")), F.lit(_ID), F.lit(0)))
    rows = rows.select("record", ids.alias("ids"), F.lower(F.concat_ws("\n", "id", "content", "payload_json")).alias("hay"))
    return rows.select(F.col("record").alias("id"), F.size("ids").alias("n_ids"), F.forall("ids", lambda x: F.contains(F.col("hay"), x)).alias("held"))


@query("f07_token_estimate", rf"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(ceil(strlen(text) / 3), ceil(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * CAST(1.35 AS DOUBLE)), 1) AS BIGINT) END AS tokens FROM documents WHERE text IS NOT NULL")
def f07(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_EN = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_RU = "['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря']"


@query("f08_signals", f"WITH {SQL_LOG}, b AS (SELECT id, created_at, list_filter(list_transform(coalesce(files, []), lambda f: string_split(replace(f, chr(92), '/'), '/')[-1]), lambda f: f <> '') AS fs FROM log) SELECT id, concat_ws(' ', {_EN}[month(created_at)], day(created_at), year(created_at), day(created_at), {_RU}[month(created_at)], year(created_at)) AS day_words, array_to_string(list_filter(fs, lambda f, i: list_position(fs, f) = i), ' ') AS names FROM b")
def f08(spark, d):
    """What an event is found by besides its text: its date in words of two languages and the names of its files, each once."""
    return log(spark, d).select("id", X.date_signals(F.col("created_at")).alias("day_words"), X.file_signals(F.coalesce("files", F.array().cast("array<string>"))).alias("names"))


def _sql_redacted(column: str) -> str:
    for name, pattern, by in X.SECRET_RULES:
        column = f"regexp_replace({column}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return column


@query("f09_redacted_secrets", f"SELECT doc_id, md5({_sql_redacted('text')}) AS digest FROM documents")
def f09(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(X.redact_secrets(F.col("text"))).alias("digest"))


def _sql_counts() -> str:
    text, out = "text", []
    for name, pattern, by in X.SECRET_RULES:
        out.append(f"sum(len(regexp_extract_all({text}, '{pattern}'))) AS {name}")
        text = f"regexp_replace({text}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return ", ".join(out)


@query("f13_redaction_counts", f"SELECT {_sql_counts()}, count(*) AS n FROM documents")
def f13(spark, d):
    """How often each rule applies, over all texts; later rules see what earlier ones put in."""
    counts = read(spark, d, "documents").select(X.secret_counts(F.col("text")).alias("c"))
    return counts.agg(*[F.sum(f"c.{name}").alias(name) for name, _, _ in X.SECRET_RULES], F.count(F.lit(1)).alias("n"))


@query("f12_framed_untrusted", f"WITH {SQL_LOG} SELECT id, md5('<untrusted>' || chr(10) || replace(content, '</untrusted>', '&lt;/untrusted&gt;') || chr(10) || '</untrusted>') AS digest FROM log WHERE kind = 'tool_output' AND content IS NOT NULL")
def f12(spark, d):
    return log(spark, d, "kind = 'tool_output' and content is not null").select("id", F.md5(X.escape_untrusted(F.col("content"))).alias("digest"))


@query("f14_row_digests", f"WITH {SQL_LOG} SELECT seq, sha256(CAST(json_object('branch_id', branch_id, 'content', content, 'files', files, 'id', id, 'kind', kind, 'seq', seq) AS VARCHAR)) AS digest FROM log")
def f14(spark, d):
    """Digests of rows as canonical JSON: keys in order, no blanks, nulls written."""
    row = F.struct("branch_id", "content", "files", "id", "kind", "seq")
    return log(spark, d).select("seq", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("f15_normalized_keys", rf"WITH {SQL_MEMORIES} SELECT lower(trim(regexp_replace(content, '[\s\p{{Z}}]+', ' ', 'g'))) AS key, count(*) AS n FROM mem GROUP BY 1")
def f15(spark, d):
    return memories(spark, d).groupBy(X.normalized_key(F.col("content")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_previews", r"SELECT doc_id, substr(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), 1, 140) AS preview FROM documents")
def f16(spark, d):
    return read(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 140).alias("preview"))


@query("f17_list_lines", r"SELECT doc_id, regexp_replace(trim(line), '^- ', '') AS entry FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE starts_with(trim(line), '- ')")
def f17(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.trim("line").startswith("- ")).select("doc_id", F.regexp_replace(F.trim("line"), "^- ", "").alias("entry"))


@query("f18_path_suffix", f"WITH {SQL_LOG}, f AS (SELECT DISTINCT file FROM (SELECT unnest(files) AS file FROM log)), w AS (SELECT DISTINCT array_to_string(string_split(file, '/')[-1:], '/') AS suffix FROM (SELECT unnest(files) AS file FROM log WHERE kind = 'tool_call')) SELECT w.suffix, count(*) AS n FROM w JOIN f ON f.file = w.suffix OR ends_with(f.file, '/' || w.suffix) GROUP BY 1")
def f18(spark, d):
    """Files that end with a wanted path on the border of a segment: every suffix of a file is looked up."""
    files = log(spark, d, "size(files) > 0").select("kind", F.explode("files").alias("file"))
    wanted = files.where("kind = 'tool_call'").select(F.substring_index("file", "/", -1).alias("suffix")).distinct()
    parts = F.split("file", "/")
    ends = files.select("file").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "/"))).alias("suffix"))
    return ends.join(wanted, "suffix").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


@query("f19_commands", f"WITH {SQL_LOG} SELECT content AS command, count(*) AS n FROM log WHERE kind = 'tool_call' AND (content = 'shell' OR starts_with(content, 'read_')) GROUP BY 1")
def f19(spark, d):
    hit = (F.col("content") == "shell") | F.col("content").startswith("read_")
    return log(spark, d, (F.col("kind") == "tool_call") & hit).groupBy(F.col("content").alias("command")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_first_failure", rf"WITH {SQL_LOG} SELECT id, substr(list_filter(list_transform(string_split_regex(content, '\r\n?|\n'), lambda l: trim(regexp_replace(l, '[\s\p{{Z}}]+', ' ', 'g'))), lambda l: regexp_matches(l, '{X.FAILURE}'))[1], 1, 240) AS line FROM log WHERE kind = 'tool_output' AND content IS NOT NULL")
def f20(spark, d):
    return log(spark, d, "kind = 'tool_output' and content is not null").select("id", X.first_failure_line(F.col("content")).alias("line"))


@query("f21_low_information", rf"WITH {SQL_LOG} SELECT id FROM log WHERE kind = 'tool_output' AND regexp_matches(content, '{X.FAILURE}') AND length(trim(content)) < 60")
def f21(spark, d):
    """Failures that say nothing but that something failed."""
    return log(spark, d, (F.col("kind") == "tool_output") & F.col("content").rlike(X.FAILURE) & (F.length(F.trim("content")) < 60)).select("id")


_SQL_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), '{'|'.join(w)}') THEN '{n}'" for n, w in X.FAMILIES) + " ELSE 'generic' END"


@query("f22_tool_family", f"WITH {SQL_LOG} SELECT {_SQL_FAMILY} AS family, count(*) AS n FROM log WHERE kind = 'tool_call' AND content IS NOT NULL GROUP BY 1")
def f22(spark, d):
    return log(spark, d, "kind = 'tool_call' and content is not null").groupBy(X.family(F.col("content")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("f23_critical_signals")
def f23(spark, d):
    outputs = log(spark, d, "kind = 'tool_output' and content is not null")
    return outputs.select("id", F.explode(X.critical_signals(F.col("content"), True)).alias("signal"))


@query("f25_located_evidence", "SELECT DISTINCT c.id, strpos(e.current, c.evidence_quote) AS at, CAST((length(e.current) - length(replace(e.current, c.evidence_quote, ''))) / length(c.evidence_quote) AS BIGINT) AS times FROM candidates c JOIN extraction_examples e ON e.id = c.example_id WHERE length(c.evidence_quote) > 0")
def f25(spark, d):
    texts = read(spark, d, "extraction_examples").select(F.col("id").alias("example_id"), "current")
    rows = read(spark, d, "candidates").where(F.length("evidence_quote") > 0).select("id", "example_id", "evidence_quote").distinct().join(texts, "example_id")
    return rows.select("id", F.expr("instr(current, evidence_quote)").alias("at"), X.occurrences(F.col("current"), F.col("evidence_quote")).alias("times")).distinct()


@query("f26_questions", rf"WITH {SQL_LOG} SELECT id FROM log WHERE kind = 'message' AND regexp_matches(content, '[?？][\s\p{{Z}})\]*]*$')")
def f26(spark, d):
    return log(spark, d, (F.col("kind") == "message") & F.col("content").rlike(r"[?？][\s\p{Z})\]*]*$")).select("id")


_MARKER = r"(?i)^\s*(goal|constraint|decision|task|todo|fact|preference|failed|failure|lesson|next step|done)\s*:\s*(\S.*)$"


@query("f27_marker_lines", rf"WITH {SQL_LOG}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM log WHERE content IS NOT NULL) SELECT id, lower(regexp_extract(line, '{_MARKER}', 1)) AS marker, regexp_extract(line, '{_MARKER}', 2) AS said FROM l WHERE regexp_matches(line, '{_MARKER}')")
def f27(spark, d):
    rows = log(spark, d, "content is not null").select("id", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(_MARKER))
    return rows.select("id", F.lower(F.regexp_extract("line", _MARKER, 1)).alias("marker"), F.regexp_extract("line", _MARKER, 2).alias("said"))


_TAG = r'^<finalize type="?([A-Za-z-]+)"?>'
# The types that a finalization may have.
FINAL_TYPES = ("goal", "decision", "fact", "constraint", "todo", "preference", "failure", "lesson")
_WHOLE_TAG = rf'(?is)^\s*<finalize type="?(?:{"|".join(FINAL_TYPES)})"?>\s*[^<\s][^<]*</finalize>\s*$'
LONGEST_FINAL = 2000
_LOOKALIKE = r"(?i)<finalize|\[\[[a-z-]+\]\]"


@query("f28_finalization_tags", f"SELECT q.id, lower(regexp_extract(q.raw_content, '{_TAG}', 1)) AS tag, contains(q.raw_content, '</finalize>') AS closed, CASE WHEN NOT regexp_matches(q.raw_content, '{_LOOKALIKE}') THEN 'untagged' WHEN regexp_matches(q.raw_content, '^\\s*(```|~~~|>)') THEN 'excluded' WHEN length(q.raw_content) <= {LONGEST_FINAL} AND regexp_matches(q.raw_content, '{_WHOLE_TAG}') THEN 'valid' ELSE 'malformed' END AS class FROM (SELECT DISTINCT id, raw_content FROM finalization_quarantine) q")
def f28(spark, d):
    """Finalizations by the strict form of their tag: one element of a known type with text and nothing nested; what is fenced or quoted is excluded."""
    rows, raw = read(spark, d, "finalization_quarantine").select("id", "raw_content").distinct(), F.col("raw_content")
    kind = F.when(raw.isNotNull() & ~raw.rlike(_LOOKALIKE), "untagged").when(raw.rlike(r"^\s*(```|~~~|>)"), "excluded").when((F.length(raw) <= LONGEST_FINAL) & raw.rlike(_WHOLE_TAG), "valid").otherwise("malformed")
    return rows.select("id", F.lower(F.regexp_extract("raw_content", _TAG, 1)).alias("tag"), F.contains("raw_content", F.lit("</finalize>")).alias("closed"), kind.alias("class"))


@query("f31_fingerprints", f"WITH {SQL_MEMORIES} SELECT id, sha256(concat_ws(chr(0), id, memory_type, content)) AS fingerprint FROM mem")
def f31(spark, d):
    return memories(spark, d).select("id", F.sha2(F.concat_ws("\x00", "id", "memory_type", "content"), 256).alias("fingerprint"))


# Words that say nothing about what a fact is of.
FACT_STOPWORDS = "the a an of to in on at for with and or by from was were is are their they user assistant claude that this his her its as had have has been".split()
_FACT_WORD = r"[\p{L}\p{N}:+-]+"
_FACT_DATE = r"^\d{4}$|^\d{1,2}$|^\d{4}-\d{2}-\d{2}"


def fact_terms(column):
    """The words of a fact, three letters or more, without stopwords and what looks like a date."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(_FACT_WORD), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*FACT_STOPWORDS) & ~w.rlike(_FACT_DATE))


def fact_terms_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '{_FACT_WORD}'), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in FACT_STOPWORDS)}], w) AND NOT regexp_matches(w, '{_FACT_DATE}')))"


@query("f33_containment", f"WITH {SQL_MEMORIES}, t AS (SELECT m.id, {fact_terms_sql('m.content')} AS a, {fact_terms_sql('o.content')} AS b FROM mem m JOIN mem o ON o.id = m.supersedes_id WHERE m.content IS NOT NULL AND o.content IS NOT NULL) SELECT id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x))) / least(len(a), len(b)) ELSE 0 END, 6) AS contained FROM t")
def f33(spark, d):
    """How much of the smaller of each fact and the one that it supersedes the other holds, in words that say something."""
    facts = memories(spark, d).where("content is not null").select("id", "supersedes_id", fact_terms(F.col("content")).alias("a"))
    both = facts.join(facts.select(F.col("id").alias("supersedes_id"), F.col("a").alias("b")), "supersedes_id")
    least = F.least(F.size("a"), F.size("b"))
    return both.select("id", F.round(F.when(least > 0, F.size(F.array_intersect("a", "b")) / least).otherwise(0.0), 6).alias("contained"))


_SQL_VARIANTS = r"""ans AS (SELECT DISTINCT question_id, question_type, original_correct, retrieval_hit, gold_coverage, model_answer, trim(regexp_replace(coalesce(gold_answer_or_rubric, ''), '\s+', ' ', 'g')) AS gold, lower(trim(regexp_replace(coalesce(model_answer, ''), '\s+', ' ', 'g'))) AS hay FROM rejudge_rows),
av AS (SELECT *, list_filter([gold] || list_transform(regexp_extract_all(gold, '\(or ([^)]+)\)', 1), lambda x: trim(x)) || [trim(regexp_replace(gold, '\([^)]*\)', '', 'g'))], lambda x: length(x) >= 2) AS vs, regexp_full_match(gold, '[\d,.$ ]{1,12}') AS aggregate FROM ans),
ax AS (SELECT *, len(list_filter(vs, lambda x: length(x) <= 30)) > 0 AS extractive, len(list_filter(vs, lambda x: contains(hay, lower(x)))) > 0 AS held FROM av)"""


def answers(spark, d):
    """Rows of the evaluation with the gold answer's written variants: as it stands, its alternatives, and without brackets."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = read(spark, d, "rejudge_rows").select("question_id", "question_type", "original_correct", "retrieval_hit", "gold_coverage", "model_answer", flat("gold_answer_or_rubric").alias("gold"), F.lower(flat("model_answer")).alias("hay")).distinct()
    gold = F.col("gold")
    variants = F.concat(F.array(gold), F.transform(F.regexp_extract_all(gold, F.lit(r"\(or ([^)]+)\)"), F.lit(1)), lambda x: F.trim(x)), F.array(F.trim(F.regexp_replace(gold, r"\([^)]*\)", ""))))
    rows = rows.withColumn("vs", F.filter(variants, lambda x: F.length(x) >= 2)).withColumn("aggregate", gold.rlike(r"^[\d,.$ ]{1,12}$"))
    return rows.withColumn("extractive", F.exists("vs", lambda x: F.length(x) <= 30)).withColumn("held", F.exists("vs", lambda x: F.contains(F.col("hay"), F.lower(x))))


@query("f36_answer_variants", f"WITH {_SQL_VARIANTS} SELECT DISTINCT question_id, extractive, aggregate, held FROM ax WHERE model_answer IS NOT NULL")
def f36(spark, d):
    return answers(spark, d).where("model_answer is not null").select("question_id", "extractive", "aggregate", "held").distinct()


@query("a29_deep_census", f"WITH {_SQL_VARIANTS} SELECT question_type, CASE WHEN NOT retrieval_hit THEN 'retrieval' WHEN gold_coverage < 1 THEN 'packing' WHEN gold = '' THEN 'passage:none' WHEN aggregate THEN 'passage:short_numeric' WHEN NOT extractive THEN 'passage:indeterminate' WHEN held THEN 'passage:yes' ELSE 'passage:no' END AS stage, count(*) AS n FROM ax WHERE NOT original_correct GROUP BY 1, 2")
def a29(spark, d):
    """At which stage each wrong answer was lost: not retrieved, not packed whole, or packed, by whether the answer holds a variant of the gold one."""
    stage = F.when(~F.col("retrieval_hit"), "retrieval").when(F.col("gold_coverage") < 1, "packing").when(F.col("gold") == "", "passage:none").when(F.col("aggregate"), "passage:short_numeric")
    stage = stage.when(~F.col("extractive"), "passage:indeterminate").when(F.col("held"), "passage:yes").otherwise("passage:no")
    return answers(spark, d).where("not original_correct").groupBy("question_type", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


# Prices of a million tokens, read and written.
READ_PRICE, WRITTEN_PRICE = 3.0, 15.0
_SQL_SIZE = r"CASE WHEN length(content) = 0 THEN 0 ELSE CAST(greatest(ceil(strlen(content) / 3), ceil(len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) * CAST(1.35 AS DOUBLE)), 1) AS BIGINT) END"


@query("f38_model_cost", f"WITH {SQL_LOG}, t AS (SELECT session_id, role = 'assistant' AS own, {_SQL_SIZE} AS tokens FROM log WHERE content IS NOT NULL), s AS (SELECT session_id, CAST(coalesce(sum(CASE WHEN own THEN 0 ELSE tokens END), 0) AS BIGINT) AS read_, CAST(coalesce(sum(CASE WHEN own THEN tokens ELSE 0 END), 0) AS BIGINT) AS written FROM t GROUP BY 1) SELECT session_id, read_, written, round((read_ * {READ_PRICE} + written * {WRITTEN_PRICE}) / 1000000, 9) AS cost FROM s")
def f38(spark, d):
    """What each session costs: the assistant's tokens are written, all others read."""
    own, tokens = F.coalesce(F.col("role") == "assistant", F.lit(False)), X.token_estimate(F.col("content"))
    sums = log(spark, d, "content is not null").select("session_id", own.alias("own"), tokens.alias("tokens")).groupBy("session_id").agg(F.sum(F.when(F.col("own"), 0).otherwise(F.col("tokens"))).alias("read_"), F.sum(F.when(F.col("own"), F.col("tokens")).otherwise(0)).alias("written"))
    return sums.withColumn("cost", F.round((F.col("read_") * READ_PRICE + F.col("written") * WRITTEN_PRICE) / 1000000, 9))


@query("f39_trust", f"WITH {SQL_LOG} SELECT CASE WHEN origin_channel = 'hook' AND role = 'user' THEN 'host_logical_user' WHEN origin_channel = 'hook' AND role = 'assistant' AND origin_adapter IS NOT NULL THEN 'host_assistant' WHEN origin_channel = 'host' THEN 'local_operator' ELSE 'external_untrusted' END AS trust, count(*) AS n FROM log GROUP BY 1")
def f39(spark, d):
    trust = (
        F.when((F.col("origin_channel") == "hook") & (F.col("role") == "user"), "host_logical_user")
        .when((F.col("origin_channel") == "hook") & (F.col("role") == "assistant") & F.col("origin_adapter").isNotNull(), "host_assistant")
        .when(F.col("origin_channel") == "host", "local_operator")
        .otherwise("external_untrusted")
    )
    return log(spark, d).groupBy(trust.alias("trust")).agg(F.count(F.lit(1)).alias("n"))


@query("f42_accuracy_interval", "WITH r AS (SELECT DISTINCT question_id, question_type, original_correct FROM rejudge_rows WHERE original_correct IS NOT NULL), a AS (SELECT question_type, avg(CAST(original_correct AS INT)) AS p, count(*) AS n FROM r GROUP BY 1) SELECT question_type, n, round(p, 4) AS accuracy, round(1.96 * sqrt(p * (1 - p) / n), 4) AS ci95 FROM a")
def f42(spark, d):
    rows = read(spark, d, "rejudge_rows").where("original_correct is not null").select("question_id", "question_type", "original_correct").distinct()
    stats = rows.groupBy("question_type").agg(F.avg(F.col("original_correct").cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    return stats.select("question_type", "n", F.round("p", 4).alias("accuracy"), F.round(1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), 4).alias("ci95"))
