"""Call and output pairing against a stack walked by hand, whatever the range width."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import pairing as P
from tracelake.plans import ordered


def walked(rows):
    """Closing rows with the last open row of their key."""
    stacks, out = {}, {}
    for key, seq, kind in sorted(rows, key=lambda r: r[1]):
        stack = stacks.setdefault(key, [])
        if kind == "open":
            stack.append(seq)
        elif kind == "close" and stack:
            out[seq] = stack.pop()
    return out


@pytest.mark.parametrize("width", [5, 50_000])
def test_last_open(spark, monkeypatch, width):
    for f in (ordered.with_running_sum, ordered.with_running_min, ordered.with_previous):
        monkeypatch.setattr(f, "__defaults__", (width,))
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), i, rng.choice(["open", "close", "close", "open", "other"])) for i in rng.sample(range(400), 200)]
    frame = spark.createDataFrame(rows, "k string, seq bigint, kind string")
    got = {r.seq: r.own for r in P.last_open(frame, ["k"], "seq", F.col("kind") == "open", F.col("kind") == "close", "own").collect()}
    assert len(got) == 200 and {k: v for k, v in got.items() if v is not None} == walked(rows)


def test_call_groups(spark):
    rows = [
        ("s", 1, "message", None), ("s", 2, "tool_call", "a"), ("s", 3, "tool_call", None), ("s", 4, "tool_output", "zz"), ("s", 5, "tool_output", "a"),
        ("s", 6, "tool_output", None), ("s", 7, "tool_call", "b"), ("s", 8, "tool_call", "b"), ("s", 9, "tool_output", "b"), ("s", 10, "state", None), ("t", 11, "tool_output", "b"),
    ]
    frame = spark.createDataFrame([(f"e{n}", s, n, k, None if c is None else f'{{"call_id":"{c}"}}') for s, n, k, c in rows], "id string, session_id string, seq bigint, kind string, payload_json string")
    got = {r.seq: r.grp for r in P.call_groups(frame, ["session_id"]).collect()}
    # 4 has no call of its id and takes the last call left open, 6 finds none left; 9 takes the later call of its id
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 2, 7: 7, 8: 8, 9: 8}
    assert P.call_groups(frame.limit(0), ["session_id"]).count() == 0
