"""Pairing of closing rows with the last row that is still open, as brackets are paired.

The depth of a row is a running sum; a closing row belongs to the nearest opening row of the same depth
before it. Running sums and neighbours are taken by ranges of the order column, so that a hot key is
spread over many tasks.

Defined results: a closing row without an open one stays alone; null keys are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans import ordered as O
from tracelake.plans.cut import cut


def last_open(rows: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: for closing rows, the order value of the row that they close."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    # each step looks at its rows twice: what it starts from is a table of a few numbers
    part = cut(rows.select(*keys, order, step.alias("_step")).where("_step <> 0"))
    part = cut(O.with_running_sum(part, keys, order, F.col("_step"), "_sum"), replaces=part)
    # closing rows without an open one push the floor down; above the floor, brackets are balanced
    part = O.with_running_min(part, keys, order, F.least(F.col("_sum"), F.lit(0)), "_floor")
    depth = F.col("_sum") - F.col("_floor")
    part = part.withColumn("_level", F.when(F.col("_step") == 1, depth).otherwise(depth + 1)).withColumn("_own", F.when(F.col("_step") == 1, F.col(order)))
    part = cut(part.select(*keys, order, "_step", "_level", "_own"))
    # one row of a level after the other: open, close, open, ... but for the alone, which stand at the floor
    found = O.with_previous(part, [*keys, "_level"], order, "_own", "_before").where("_step = -1").select(F.col(order).alias("_at"), F.col("_before").alias(name))
    return rows.join(found, rows[order] == found["_at"], "left").drop("_at")


def call_groups(events: DataFrame, keys: list[str]) -> DataFrame:
    """(id, grp, call_seq): transcript rows by their group, named by its first position.

    A tool output joins the last open call of its call id, else, among the calls and outputs that this leaves, the
    last open call at all; outputs without one are left out. Every other row is a group of its own. A call whose own
    output comes later is never given to another. ``events`` has unique ``seq``.
    """
    rows = cut(events.where(F.col("kind").isin("message", "tool_call", "tool_output")).select(*keys, "id", "seq", "kind", F.get_json_object("payload_json", "$.call_id").alias("call_id")))
    call, result = F.col("kind") == "tool_call", F.col("kind") == "tool_output"
    named = last_open(rows.where("call_id is not null"), [*keys, "call_id"], "seq", call, result, "own")
    pairs = cut(named.where("own is not null").select(F.col("seq").alias("out"), "own"))
    taken = pairs.select(F.col("out").alias("seq")).unionByName(pairs.select(F.col("own").alias("seq")))
    rest = last_open(rows.where(call | result).join(taken, "seq", "left_anti"), keys, "seq", call, result, "own").where("own is not null").select(F.col("seq").alias("out"), "own")
    both = pairs.unionByName(rest)
    out = rows.join(both, rows["seq"] == both["out"], "left").where(~result | F.col("own").isNotNull())
    return cut(out.select(*keys, "id", "seq", "kind", F.coalesce("own", "seq").alias("grp"), F.col("own").alias("call_seq")), replaces=rows)
