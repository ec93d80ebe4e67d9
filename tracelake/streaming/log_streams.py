"""Structured Streaming twins of the incremental operators.

Each function takes a streaming DataFrame of events and returns a streaming
DataFrame; ``drain`` runs one over all stored files with ``availableNow`` and
reads the result back. State is kept by event time watermarks or, for the running
counter, by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions.text import token_estimate
from tracelake.plans.cut import shared_folder

# Actions and the percentage of the window from which each is due.
ACTIONS = (("snapshot", 45), ("compact", 60), ("handoff", 75), ("hard_stop", 90))


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # the source wants a folder or a pattern, and a table may be one file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` to the end of what is stored and read the result back."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def once_per_receipt(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first delivery of each receipt; receipts are forgotten after ``delay`` of event time."""
    at = F.expr("unix_micros(cast(created_at as timestamp))").cast("string")
    receipt = F.sha2(F.concat_ws("\x1f", "session_id", "kind", "content", at), 256)
    rows = events.where("session_id is not null and content is not null").select(receipt.alias("receipt"), F.col("created_at").cast("timestamp").alias("at"))
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["receipt"])


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "3 hours") -> DataFrame:
    """(start, kind, n) per window of event time, final once the watermark has passed it."""
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    counts = rows.withWatermark("at", delay).groupBy(F.window("at", width), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "kind", "n")


def cumulative_counts(events: DataFrame) -> DataFrame:
    """(session_id, events, bytes): the running totals of each session, one row per batch in which it grew.

    The state is two numbers per session, whatever the session's length.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, size = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            size += int(batch["size"].sum())
        state.update((n, size))
        yield pd.DataFrame({"session_id": [key[0]], "events": [n], "bytes": [size]})

    rows = events.where("session_id is not null").select("session_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size"))
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, events bigint, bytes bigint", "events bigint, bytes bigint", "append", GroupStateTimeout.NoTimeout)


def paired_calls(events: DataFrame) -> DataFrame:
    """(call_id, call, result): a call and its output as soon as both have come, in whichever order; later deliveries add nothing.

    The state is one pair of ids per call that is still open.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        call, result, told = state.get if state.exists else (None, None, False)
        for batch in batches:
            for kind, name in batch.sort_values("seq")[["kind", "id"]].itertuples(index=False):
                if kind == "tool_call":
                    call = call or name
                else:
                    result = result or name
        whole = call is not None and result is not None
        state.update((call, result, told or whole))
        yield pd.DataFrame({"call_id": [key[0]], "call": [call], "result": [result]} if whole and not told else {"call_id": [], "call": [], "result": []}).astype(object)

    rows = events.where(F.col("kind").isin("tool_call", "tool_output")).select(F.get_json_object("payload_json", "$.call_id").alias("call_id"), "kind", "id", "seq").where("call_id is not null")
    return rows.groupBy("call_id").applyInPandasWithState(step, "call_id string, call string, result string", "call string, result string, told boolean", "append", GroupStateTimeout.NoTimeout)


def snapshot_cadence(events: DataFrame, most: int) -> DataFrame:
    """(branch_id, seq, bytes): where a branch's tail of events has grown to ``most`` bytes since its last snapshot.

    The state is the size of the tail. Events count as they come, those of one Arrow batch in order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else 0
        for batch in batches:
            due = []
            for seq, size in batch.sort_values("seq")[["seq", "size"]].itertuples(index=False):
                tail += int(size)
                if tail >= most:
                    due.append((key[0], seq, tail))
                    tail = 0
            yield pd.DataFrame(due, columns=["branch_id", "seq", "bytes"]).astype({"branch_id": object})
        state.update((tail,))

    rows = events.select(F.coalesce(F.lower(F.trim("branch_id")), F.lit("")).alias("branch_id"), "seq", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size"))
    return rows.groupBy("branch_id").applyInPandasWithState(step, "branch_id string, seq bigint, bytes bigint", "tail bigint", "append", GroupStateTimeout.NoTimeout)


def governed(events: DataFrame, window: int, interval: int) -> DataFrame:
    """(branch_id, seq, action, bucket): what a budget of ``window`` tokens calls for as a branch's context grows.

    An action is taken again only ``interval`` positions after the last one of its kind and once per bucket of a twentieth of
    the window. The state is the context's size and, of each action, the last position and bucket. Events count as they
    come, those of one Arrow batch in order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, *marks = state.get if state.exists else (0, *[-1] * (2 * len(ACTIONS)))
        for batch in batches:
            taken = []
            for seq, tokens in batch.sort_values("seq")[["seq", "tokens"]].itertuples(index=False):
                size += int(tokens)
                bucket = size // max(1, -(-window // 20))
                for n, (action, share) in enumerate(ACTIONS):
                    last, told = marks[2 * n : 2 * n + 2]
                    if size >= -(-window * share // 100) and (last < 0 or seq - last >= interval) and bucket != told:
                        marks[2 * n : 2 * n + 2] = int(seq), bucket
                        taken.append((key[0], int(seq), action, bucket))
            yield pd.DataFrame(taken, columns=["branch_id", "seq", "action", "bucket"]).astype({"branch_id": object, "action": object})
        state.update((size, *marks))

    rows = events.select(F.coalesce(F.lower(F.trim("branch_id")), F.lit("")).alias("branch_id"), "seq", F.coalesce(token_estimate(F.col("content")), F.lit(0)).alias("tokens"))
    fields = ", ".join(f"{action}_{x} bigint" for action, _ in ACTIONS for x in ("at", "bucket"))
    return rows.groupBy("branch_id").applyInPandasWithState(step, "branch_id string, seq bigint, action string, bucket bigint", f"size bigint, {fields}", "append", GroupStateTimeout.NoTimeout)
