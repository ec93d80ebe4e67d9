"""Streaming operators, drained over the stored tables (x..)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.registry import query
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, log, memories, read
from tracelake.streaming import log_streams as S


@query("x01_receipts_once", "SELECT count(DISTINCT sha256(concat(session_id, chr(31), kind, chr(31), content, chr(31), CAST(epoch_us(created_at) AS VARCHAR)))) AS receipts FROM event_log WHERE session_id IS NOT NULL AND content IS NOT NULL")
def x01(spark, d):
    return S.drain(S.once_per_receipt(S.source(spark, d, "event_log"))).agg(F.count(F.lit(1)).alias("receipts"))


@query("x02_running_counters", "SELECT session_id, count(*) AS events, CAST(sum(coalesce(strlen(content), 0)) AS BIGINT) AS bytes FROM event_log WHERE session_id IS NOT NULL GROUP BY 1")
def x02(spark, d):
    """The last totals of each session."""
    rows = S.drain(S.cumulative_counts(S.source(spark, d, "event_log")))
    return rows.groupBy("session_id").agg(F.max("events").alias("events"), F.max("bytes").alias("bytes"))


@query("x06_retryable", f"WITH {SQL_MEMORIES} SELECT run_id, count(*) AS attempts, count(*) <= 3 AS retryable FROM mem WHERE initial_status = 'rejected' GROUP BY 1")
def x06(spark, d):
    n = F.count(F.lit(1))
    return memories(spark, d).where("initial_status = 'rejected'").groupBy("run_id").agg(n.alias("attempts"), (n <= 3).alias("retryable"))


#: The instant at which the projection was last brought up to date.
SYNCED_AT = "2024-01-15 00:00:00"


@query("x07_unsynced", f"WITH {SQL_MEMORIES}, o AS (SELECT id, sha256(concat_ws(chr(0), id, memory_type, content)) AS f FROM mem WHERE created_at <= TIMESTAMP '{SYNCED_AT}') SELECT m.id FROM mem m LEFT JOIN o ON o.id = m.id AND o.f = sha256(concat_ws(chr(0), m.id, m.memory_type, m.content)) WHERE o.id IS NULL")
def x07(spark, d):
    """Facts that a projection of an earlier instant does not hold with their present fingerprint."""
    rows = memories(spark, d).withColumn("f", F.sha2(F.concat_ws("\0", "id", "memory_type", "content"), 256))
    held = rows.where(F.col("created_at") <= F.lit(SYNCED_AT).cast("timestamp_ntz")).select("id", "f")
    return rows.join(held, ["id", "f"], "left_anti").select("id")


@query("x09_indexed_through", f"WITH {SQL_LOG} SELECT origin_channel, max(seq) AS indexed_through FROM log GROUP BY 1")
def x09(spark, d):
    return log(spark, d).groupBy("origin_channel").agg(F.max("seq").alias("indexed_through"))


@query("x10_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, nth")
def x10(spark, d):
    """Sessions of each user with gaps under six hours."""
    rows = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return rows.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("x10_tumbling_stream", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def x10_stream(spark, d):
    """Counts per hour: the closed windows of the stream, and those of the newest hours as they stand at its end."""
    closed = S.drain(S.tumbling_counts(S.source(spark, d, "events")))
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    open_ = rows.groupBy(F.date_trunc("hour", "at").alias("start"), "kind").agg(F.count(F.lit(1)).alias("n")).join(closed.select("start", "kind"), ["start", "kind"], "left_anti")
    return closed.unionByName(open_).select(F.unix_micros("start").alias("start_us"), "kind", "n")


@query("x04_online_pairs", "WITH e AS (SELECT json_extract_string(payload_json, '$.call_id') AS call_id, kind, id, seq FROM event_log WHERE kind IN ('tool_call', 'tool_output')) SELECT call_id, arg_min(CASE WHEN kind = 'tool_call' THEN id END, CASE WHEN kind = 'tool_call' THEN seq END) AS call, arg_min(CASE WHEN kind = 'tool_output' THEN id END, CASE WHEN kind = 'tool_output' THEN seq END) AS result FROM e WHERE call_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT kind) = 2")
def x04(spark, d):
    return S.drain(S.paired_calls(S.source(spark, d, "event_log")))


#: Bytes of events behind a snapshot from which the next is due.
TAIL_BYTES = 4 * 512


@query("x11_due_snapshots")
def x11(spark, d):
    return S.drain(S.snapshot_cadence(S.source(spark, d, "event_log"), TAIL_BYTES))


@query("x03_governed")
def x03(spark, d):
    """Actions that a window of 4000 tokens calls for, each at most every twenty positions."""
    return S.drain(S.governed(S.source(spark, d, "event_log"), 4000, 20))
