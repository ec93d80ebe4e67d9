"""Ranged ordered operations equal plain windows, whatever the range, nulls and hot keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import lineage as L
from tracelake.plans import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in rng.sample(range(1000), 300)]
    return spark.createDataFrame(data, "k string, seq bigint, v int").cache()


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_equal_windows(rows, width):
    w = Window.partitionBy("k").orderBy("seq")
    value = F.coalesce("v", F.lit(0))
    expected = rows.select("k", "seq", F.lag("v").over(w).alias("prev"), F.sum(value).over(w).alias("sum"), F.min(F.when(F.col("v") == 2, F.col("seq"))).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    got = O.with_previous(rows, ["k"], "seq", "v", "prev", width)
    got = O.with_running_sum(got, ["k"], "seq", value, "sum", width)
    got = O.with_next_where(got, ["k"], "seq", F.col("v") == 2, "next", width)
    as_set = lambda df: sorted(map(str, df.select("k", "seq", "prev", "sum", "next").collect()))
    assert as_set(got) == as_set(expected)


def test_last_of_each(rows):
    got = {(r.k, r.back): r.seq for r in O.last_of_each(rows, ["k"], "seq", 3, 50).collect()}
    for key in ("hot", "a", "b", None):
        seqs = sorted((r.seq for r in rows.where(F.col("k").eqNullSafe(F.lit(key))).collect()), reverse=True)[:3]
        assert [got[key, i + 1] for i in range(3)] == seqs


def test_last_at(spark, monkeypatch):
    monkeypatch.setattr(L, "SEQ_RANGE", 10)
    events = spark.createDataFrame([("a", s) for s in (3, 14, 15, 40)] + [("b", 7)], "key string, seq bigint")
    points = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "a", 39), (4, "a", 99), (5, "b", 6), (6, "c", 9)], "n int, key string, seq bigint")
    assert {r.n: r.last for r in L.last_at(points, events, "key", "seq").collect()} == {1: None, 2: 3, 3: 15, 4: 40, 5: None, 6: None}


def test_following_over_all_rows(spark):
    values = [f"{a}{b}" for a in "abcab" for b in range(40)] + ["", None]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(values))], "word string, n int").repartition(5)
    got = {r.word: r.after for r in O.with_following(rows, "word", "after").collect()}
    known = sorted(v for v in got if v is not None)
    assert len(got) == len(set(values)) and got[None] is None
    assert [got[v] for v in known] == [*known[1:], None]
    assert O.with_following(rows.limit(0), "word", "after").count() == 0
