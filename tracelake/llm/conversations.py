"""Rebuilding conversations from message rows.

Messages are partitioned by session and by a range of ``seq``, sorted by ``seq``
inside each part, and checked by a finite-state automaton whose state is the last
speaker. Because the state is the last symbol, a part's effect on the automaton
is its first and last speaker and its own violations; parts are joined by these,
so that a session with a third of all rows is never sorted by one task.

Defined results: null session ids are left out; null or blank ids are not merged
by id; null content and content without a visible character count as absent;
null or blank roles are unknown speakers; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the ranges of ``seq`` that are sorted and checked in one piece.
SEQ_RANGE = 50_000
#: A text with none of these shows nothing: not a blank, control, format or filler character.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"

START, USER, ASSISTANT, UNKNOWN = "start", "user", "assistant", "unknown"
#: The automaton's faults by (state, next speaker); END closes a session.
END = "end"
FAULTS = {
    (START, ASSISTANT): "first_turn_not_user",
    (START, END): "empty",
    (USER, USER): "missing_reply",
    (USER, END): "missing_reply",
}


def _fault(state: Column, symbol: Column) -> Column:
    out = F.when(symbol == UNKNOWN, "unknown_speaker")
    for (before, now), name in FAULTS.items():
        out = out.when((state == before) & (symbol == now), name)
    return out


def message_turns(events: DataFrame) -> DataFrame:
    """(session_id, seq, role): the deliveries that count, one row each.

    A delivery repeated with the same id, or with the same session, role, content
    and created_at, counts at its lowest seq. System messages and messages with
    nothing to see are left out; role is user, assistant or unknown.
    """
    role = F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = events.where((F.col("kind") == "message") & F.col("session_id").isNotNull()).select(
        F.coalesce(F.when(F.trim("id") != "", F.col("id")), F.concat(F.lit("seq "), F.col("seq").cast("string"))).alias("id"),
        F.struct(
            "seq",
            "session_id",
            role.alias("role"),
            F.coalesce(F.md5("content"), F.lit("")).alias("digest"),
            "created_at",
            F.coalesce(F.col("content").rlike(VISIBLE), F.lit(False)).alias("visible"),
        ).alias("m"),
    )
    by_id = rows.groupBy("id").agg(F.min("m").alias("m")).select("m.*")
    once = by_id.groupBy("session_id", "role", "digest", "created_at").agg(F.min("seq").alias("seq"), F.max("visible").alias("visible"))
    known = F.when(F.col("role").isin(USER, ASSISTANT), F.col("role")).otherwise(UNKNOWN)
    return once.where(F.col("visible") & (F.col("role") != "system")).select("session_id", "seq", known.alias("role"))


def _parts(turns: DataFrame) -> DataFrame:
    """(session_id, part, n, first, last, fault): each part's effect on the automaton."""
    part = Window.partitionBy("session_id", "part").orderBy("seq")
    turns = turns.withColumn("part", F.floor(F.col("seq") / SEQ_RANGE)).withColumn("state", F.lag("role").over(part))
    return turns.groupBy("session_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("role", "seq").alias("first"), F.max_by("role", "seq").alias("last"), F.min(_fault(F.col("state"), F.col("role"))).alias("fault")
    )


def _verdicts(parts: DataFrame) -> DataFrame:
    """(session_id, fault): the fault of each session with at least one turn, null if it is whole."""
    order = Window.partitionBy("session_id").orderBy("part")
    at = F.coalesce(F.lag("last").over(order), F.lit(START))
    final = F.when(F.lead("part").over(order).isNull(), _fault(F.col("last"), F.lit(END)))
    joined = parts.select("session_id", F.coalesce("fault", _fault(at, F.col("first")), final).alias("fault"))
    return joined.groupBy("session_id").agg(F.min("fault").alias("fault"))


def broken_sessions(events: DataFrame) -> DataFrame:
    """(session_id, fault) of each non-null session that is not a whole conversation.

    The fault is empty, unknown_speaker, first_turn_not_user or missing_reply.
    """
    sessions = events.where("session_id is not null").select("session_id").distinct()
    verdicts = _verdicts(_parts(message_turns(events))).withColumn("seen", F.lit(True))
    return sessions.join(verdicts, "session_id", "left").select("session_id", F.when(F.col("seen").isNull(), "empty").otherwise(F.col("fault")).alias("fault")).where("fault is not null")


def conversations(events: DataFrame) -> DataFrame:
    """(session_id, turn, seq, role, content): the turns of the whole sessions, numbered from 1 by seq."""
    turns = message_turns(events)
    parts = _parts(turns)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("session_id", "part", before.alias("before"))
    whole = _verdicts(parts).where("fault is null").select("session_id")
    place = F.row_number().over(Window.partitionBy("session_id", "part").orderBy("seq"))
    numbered = turns.join(whole, "session_id", "left_semi").withColumn("part", F.floor(F.col("seq") / SEQ_RANGE)).withColumn("place", place)
    texts = events.where((F.col("kind") == "message") & F.col("session_id").isNotNull()).groupBy("session_id", "seq").agg(F.first("content", ignorenulls=True).alias("content"))
    return (
        numbered.join(offsets, ["session_id", "part"])
        .join(texts, ["session_id", "seq"])
        .select("session_id", (F.col("before") + F.col("place")).alias("turn"), "seq", "role", "content")
    )
