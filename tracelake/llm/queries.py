"""Registered queries of the training-data operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import consensus, conversations, leakage, packing, pairs, pii, quality, textform


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "event_log").select(F.col("id").alias("record_id"), "content")
    return events.unionByName(_read(spark, sf_dir, "finalization_quarantine").select(F.col("id").alias("record_id"), F.col("raw_content").alias("content")))


def p1_found(spark, d):
    return conversations.broken_sessions(_read(spark, d, "event_log")).select("session_id")


def p1_conversations(spark, d):
    return conversations.conversations(_read(spark, d, "event_log"))


def p2_found(spark, d):
    examples, candidates = _read(spark, d, "extraction_examples"), _read(spark, d, "candidates")
    return textform.same_look_pairs(examples, "id", "current").unionByName(textform.requoted_pairs(candidates, examples)).distinct()


def p2_canonical(spark, d):
    """Every text of the problem in its one form; ``changed`` tells whether it was another."""
    examples = _read(spark, d, "extraction_examples").select("id", F.lit("current").alias("field"), F.col("current").alias("text"))
    quotes = _read(spark, d, "extraction_examples").select("id", F.lit("expected").alias("field"), F.explode("expected.evidence_quote").alias("text"))
    candidates = _read(spark, d, "candidates").select("id", F.lit("quote").alias("field"), F.col("evidence_quote").alias("text"))
    rows = examples.unionByName(quotes).unionByName(candidates).withColumn("canonical", textform.canonical_text("text"))
    return rows.select("id", "field", "canonical", (~F.col("canonical").eqNullSafe(F.col("text"))).alias("changed"))


def p2_classes(spark, d):
    return textform.look_classes(_read(spark, d, "extraction_examples"), "id", "current")


def p3_found(spark, d):
    return pii.found(_personal_texts(spark, d), _read(spark, d, "people"))


def p3_redacted(spark, d):
    return pii.redacted(_personal_texts(spark, d), _read(spark, d, "people")).select("record_id", "content", F.array_join("pii_types", ",").alias("pii_types"))


def p5_found(spark, d):
    return pairs.defects(_read(spark, d, "rejudge_rows")).where("defect_type is not null")


def p5_verdicts(spark, d):
    return pairs.defects(_read(spark, d, "rejudge_rows")).select("question_id", F.coalesce("defect_type", F.lit("sound")).alias("verdict"))


def p6_found(spark, d):
    items, _ = consensus.consensus(_read(spark, d, "rejudge_labels"))
    return items.select(F.col("item").alias("question_id"), (F.col("p") > 0.5).cast("bigint").alias("consensus"))


def p6_agreement(spark, d):
    items, _ = consensus.consensus(_read(spark, d, "rejudge_labels"))
    return items.select(F.col("item").alias("question_id"), "p", "n_votes", "agreement")


def p6_judges(spark, d):
    _, judges = consensus.consensus(_read(spark, d, "rejudge_labels"))
    return judges


def p7_packed(spark, d):
    return packing.pack(packing.token_counts(_read(spark, d, "documents")), _read(spark, d, "context_budgets"))


def p7_fill(spark, d):
    return packing.fill(p7_packed(spark, d))


def p8_found(spark, d):
    return leakage.leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_report(spark, d):
    """Every item with the number of documents that hold a passage of it and the longest passage's share of the item."""
    items = _read(spark, d, "eval_items").where("item_id is not null").select("item_id").distinct()
    leaks = leakage.leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"), short=True)
    per_item = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max(F.col("run_words") / F.col("item_words")).alias("most_held"))
    return items.join(per_item, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_held", F.lit(0.0)).alias("most_held"))


def p9_found(spark, d):
    return quality.forms(_read(spark, d, "documents")).where("form <> 'prose'").select("doc_id", "form").distinct()


def p9_statistics(spark, d):
    repeated, dominant = quality.repetition()
    return quality.statistics(_read(spark, d, "documents")).withColumn("form", quality.form_rules()).withColumn("boilerplate", repeated | dominant)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_conversations, p2_found, p2_canonical, p2_classes, p3_found, p3_redacted, p5_found, p5_verdicts, p6_found, p6_agreement, p6_judges, p7_packed, p7_fill, p8_found, p8_report, p9_found, p9_statistics)
    return {f.__name__: f for f in named}


_P1_TURNS = r"""
  WITH m AS (
    SELECT coalesce(nullif(trim(id), ''), 'seq ' || seq) AS k, seq, session_id, lower(trim(coalesce(role, ''))) AS role, content, created_at
    FROM event_log WHERE kind = 'message' AND session_id IS NOT NULL),
  by_id AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS nth FROM m) WHERE nth = 1),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role, content, created_at ORDER BY seq) AS nth2 FROM by_id) WHERE nth2 = 1),
  turns AS (
    SELECT session_id, seq, content, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown' END AS role
    FROM once WHERE role <> 'system' AND regexp_matches(content, '[^\s\p{Z}\p{Cc}\p{Cf}]')),
  steps AS (
    SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY seq) AS before, lead(role) OVER (PARTITION BY session_id ORDER BY seq) AS after FROM turns),
  whole AS (
    SELECT session_id FROM steps GROUP BY session_id
    HAVING count(CASE WHEN role = 'unknown' OR (before IS NULL AND role <> 'user') OR (role = 'user' AND (after IS NULL OR after = 'user')) THEN 1 END) = 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_TURNS + "SELECT DISTINCT session_id FROM event_log WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM whole)",
        "p1_conversations": _P1_TURNS
        + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn, seq, role, content FROM turns WHERE session_id IN (SELECT session_id FROM whole)",
    }
