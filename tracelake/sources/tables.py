"""The engine's model tables, read from stored tables.

``log`` is the canonical event log with every delivery once. ``memories`` are the
extracted facts: a later extraction from the same example with the same type
supersedes the one before it, and the fact enters the log at ``cursor_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The facts of ordinal n enter the log at event n * ORD_STEP + 1.
ORD_STEP = 6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def log(spark: SparkSession, sf_dir: str, where: Column | str | None = None) -> DataFrame:
    """Events once per id; roles without case and outer blanks.

    A repeated delivery agrees with the first in all columns, so ``where`` is applied before they are
    counted once: it reaches the scan, and only rows that fulfil it are shuffled.
    """
    rows = read(spark, sf_dir, "event_log").select("seq", "id", "branch_id", "session_id", "kind", "role", "origin_channel", "origin_adapter", "content", "payload_json", "files", "created_at", "previous_hash", "content_hash", "chain_hash")
    rows = rows.withColumn("role", F.lower(F.trim("role")))
    return (rows if where is None else rows.where(where)).dropDuplicates(["id"])


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, fork): one row per branch id, ids and parents in comparison form."""
    from tracelake.operators.hierarchy import node_key

    rows = read(spark, sf_dir, "branches").select(node_key(F.col("id")).alias("node"), node_key(F.col("parent_id")).alias("parent"), F.col("fork_event_seq").alias("fork"))
    return rows.where("node is not null").groupBy("node").agg(F.max("parent").alias("parent"), F.max("fork").alias("fork"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with transaction time (``cursor_seq``), valid time, risk, cost and the fact they supersede."""
    rows = read(spark, sf_dir, "candidates").dropDuplicates(["id"])
    before = F.lag("id").over(Window.partitionBy("example_id", "memory_type").orderBy("ord", "id"))
    facts = rows.select(
        "id",
        "example_id",
        "run_id",
        "memory_type",
        F.col("normalized_content").alias("content"),
        "confidence",
        "initial_status",
        "evidence_zone",
        "ord",
        (F.col("ord") * ORD_STEP + 1).alias("cursor_seq"),
        (1 - F.col("confidence")).alias("risk"),
        (F.length("normalized_content") / 100.0).alias("retrieval_cost"),
        "valid_from",
        "valid_to",
        "valid_from_precision",
        "valid_to_precision",
        "created_at",
        before.alias("supersedes_id"),
    )
    at = log(spark, sf_dir).select(F.col("seq").alias("cursor_seq"), F.col("id").alias("source_event_id"), F.lower(F.trim("branch_id")).alias("branch_id"))
    return facts.join(at, "cursor_seq", "left").withColumn("branch_id", F.coalesce("branch_id", F.lit("main")))


#: SQL twins of the model tables, as common table expressions.
SQL_LOG = """log AS (
  SELECT seq, id, branch_id, session_id, kind, lower(trim(role)) AS role, origin_channel, origin_adapter, content, payload_json, files, created_at, previous_hash, content_hash, chain_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM event_log) WHERE nth = 1)"""
SQL_BRANCHES = """br AS (
  SELECT lower(trim(id)) AS node, max(nullif(lower(trim(parent_id)), '')) AS parent, max(fork_event_seq) AS fork FROM branches WHERE trim(id) <> '' GROUP BY 1)"""
SQL_MEMORIES = (
    SQL_LOG
    + f""", mem AS (
  SELECT c.id, c.example_id, c.run_id, c.memory_type, c.normalized_content AS content, c.confidence, c.initial_status, c.evidence_zone, c.ord, c.ord * {ORD_STEP} + 1 AS cursor_seq,
    1 - c.confidence AS risk, length(c.normalized_content) / 100.0 AS retrieval_cost, c.valid_from, c.valid_to, c.valid_from_precision, c.valid_to_precision, c.created_at,
    lag(c.id) OVER (PARTITION BY c.example_id, c.memory_type ORDER BY c.ord, c.id) AS supersedes_id, l.id AS source_event_id, coalesce(lower(trim(l.branch_id)), 'main') AS branch_id
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS nth FROM candidates) WHERE nth = 1) c
  LEFT JOIN log l ON l.seq = c.ord * {ORD_STEP} + 1)"""
)
