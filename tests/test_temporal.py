"""Three-valued predicates against sampled instants."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from tracelake.functions import temporal as T

#: (lo, hi, singleton) in hours; None is open.
ENVELOPES = [(None, None, False), (2, 2, True), (5, 5, True), (8, 8, True), (2, 5, False), (5, 8, False), (2, 8, False), (4, 6, False), (5, None, False), (None, 5, False)]


def instants(e):
    lo, hi, one = e
    if one:
        return [lo]
    return [x / 2 for x in range(-10, 40) if (lo is None or x / 2 >= lo) and (hi is None or x / 2 < hi)]


def truth(a, b, test):
    seen = {test(x, y) for x in instants(a) for y in instants(b)}
    return seen.pop() if len(seen) == 1 else None


def at(hours):
    return None if hours is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_predicates(spark):
    pairs = list(itertools.product(ENVELOPES, repeat=2))
    rows = [(i, (at(a[0]), at(a[1]), a[2]), (at(b[0]), at(b[1]), b[2])) for i, (a, b) in enumerate(pairs)]
    env = "struct<lo:timestamp_ntz,hi:timestamp_ntz,singleton:boolean>"
    frame = spark.createDataFrame(rows, f"i int, a {env}, b {env}")
    a, b = F.col("a"), F.col("b")
    for r in frame.select("i", T.lt3(a, b).alias("lt"), T.le3(a, b).alias("le"), T.eq3(a, b).alias("eq"), T.lt3(b, a).alias("gt")).collect():
        x, y = pairs[r.i]
        assert r.lt == truth(x, y, lambda p, q: p < q), (x, y)
        assert r.le == truth(x, y, lambda p, q: p <= q), (x, y)
        assert r.le == (None if r.gt is None else not r.gt)
        if x[2] and y[2] or not set(instants(x)) & set(instants(y)):
            assert r.eq == truth(x, y, lambda p, q: p == q), (x, y)


def test_status(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("current", day(1), "instant", day(9), "instant"), ("expired", day(1), "day", day(3), "day"), ("not_yet_valid", day(8), "day", None, None), ("current_open", day(1), "month", None, None), ("unknown", None, None, None, None), ("unknown", None, None, day(9), "day")]
    frame = spark.createDataFrame(rows, "want string, s timestamp_ntz, sp string, e timestamp_ntz, ep string")
    now = T.instant(F.lit("2024-01-05").cast("timestamp_ntz"))
    got = frame.select("want", T.validity_status(T.envelope(F.col("s"), F.col("sp")), T.envelope(F.col("e"), F.col("ep")), now).alias("got")).collect()
    # a month that is still running may start later
    assert [r.got for r in got] == ["current", "expired", "not_yet_valid", "unknown", "unknown", "unknown"]


def test_empty_interval(spark):
    row = spark.range(1).select(F.lit("2024-01-05").cast("timestamp_ntz").alias("x"))
    one = T.instant(F.col("x"))
    assert row.select(T.interval_error(one, one).alias("e")).first().e == "empty"
