"""Operators without a SQL twin, and rules that one table alone does not exercise, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import temporal as T
from tracelake.functions import views as V
from tracelake.operators import assembly as A
from tracelake.operators import chain, markup
from tracelake.registry import matching

NOW = "2024-03-13 15:00:00"
WINDOWS = [
    ("what happened on 2024-02-29?", "2024-02-29", "2024-03-01"),
    ("number 2024-13-45, a few days ago", "2024-03-08", "2024-03-11"),
    ("пару дней назад и вчера", "2024-03-10", "2024-03-12"),
    ("Yesterday or last week, Вчера", "2024-03-12", "2024-03-13"),
    ("last week, last month", "2024-03-04", "2024-03-11"),
    ("в прошлом месяце", "2024-02-01", "2024-03-01"),
    ("last year", "2023-01-01", "2024-01-01"),
    ("in April", "2023-04-01", "2023-05-01"),
    ("в феврале 2022", "2022-02-01", "2022-03-01"),
    ("may I march on", None, None),
    ("May 2021", "2021-05-01", "2021-06-01"),
    ("максимум маршрутов", None, None),
    ("", None, None),
    (None, None, None),
]


def test_query_windows(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(WINDOWS)], "i int, t string")
    got = {r.i: r.w for r in rows.select("i", T.query_window(F.col("t"), F.lit(NOW).cast("timestamp_ntz")).alias("w")).collect()}
    for i, (text, lo, hi) in enumerate(WINDOWS):
        w = got[i]
        assert (None if w is None else (w.start.isoformat()[:10], w.end.isoformat()[:10])) == (None if lo is None else (lo, hi)), text


BOUNDS = [
    (None, "unknown", None, None),
    ("  ", "unknown", None, None),
    ("2023", "year", "2023-01-01T00:00:00", None),
    ("2023-07", "month", "2023-07-01T00:00:00", None),
    ("2023-07-09", "day", "2023-07-09T00:00:00", None),
    ("2023-02-30", None, None, "invalid_calendar_value"),
    ("2023-13", None, None, "invalid_calendar_value"),
    ("вчера", "day", "2024-03-12T00:00:00", None),
    ("2023-07-09T10:00:00+02:00", "instant", "2023-07-09T08:00:00", None),
    ("2023-07-09T10:00:00", None, None, "naive_timestamp"),
    ("next spring", None, None, "unparseable_temporal"),
]


def test_parsed_bounds(spark):
    rows = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BOUNDS)], "i int, t string")
    got = {r.i: r.b for r in rows.select("i", T.parsed_bound(F.col("t"), F.lit(NOW).cast("timestamp_ntz")).alias("b")).collect()}
    assert [(got[i].precision, got[i].lo and got[i].lo.isoformat(), got[i].error) for i in range(len(BOUNDS))] == [b[1:] for b in BOUNDS]
    alone = rows.where("i = 7").select(T.parsed_bound(F.col("t"), F.lit(None).cast("timestamp_ntz")).alias("b")).first().b
    assert alone.error == "relative_without_anchor"


def shown(spark, view, lines):
    return spark.createDataFrame([(lines,)], "l array<string>").select(view(F.col("l")).alias("v")).first().v


def test_views(spark):
    many = [f"line {i}" for i in range(100)]
    many[50] = "ERROR in the middle"
    assert shown(spark, V.test_view, many) == many[48:53]
    assert shown(spark, V.test_view, ["ok"] * 3) == ["ok"] * 3
    assert shown(spark, V.test_view, ["a", "12 passed in 3s", "b", "c", "d", "WARNING x"]) == ["WARNING x", "12 passed in 3s"]
    assert shown(spark, V.build_view, many) == many[48:53] + many[76:]
    assert shown(spark, V.search_view, ["src/a.py:3: x", "src/a.py:3: y", "note", "retry it"]) == ["src/a.py:3", "retry it"]
    assert shown(spark, V.collapsed, ["a", "a", "a", "b", "a"]) == ["a", "[previous line repeated 2 more times]", "b", "a"]
    assert shown(spark, V.generic_view, many) == many[:24] + ["[... 52 middle lines omitted ...]"] + many[48:53] + many[76:]
    assert shown(spark, V.generic_view, many[:40]) == many[:40]
    kept = spark.createDataFrame([(["b"], ["a", "b", "c"])], "v array<string>, l array<string>").select(V.protected(F.col("v"), F.col("l"), "^[abc]$").alias("x")).first().x
    assert kept == ["b", "[protected lines]", "a", "c"]


def test_array_views():
    rows = [{"name": f"part {i}", "state": "ready", "count": i} for i in range(40)]
    form, total, kept, view = markup._array_view(json.dumps(rows))
    assert (form, total, kept) == ("csv", 40, 40) and len(view.split("\n")) == 41
    form, total, kept, view = markup._array_view(json.dumps([*rows, rows[0], {"odd": 1}]))
    assert (form, total, kept) == ("array", 42, 15) and json.loads(view)[-1] == {"_omitted": 27} and {"odd": 1} in json.loads(view)
    assert markup._array_view(json.dumps(rows[:4]))[0] == markup._array_view("no json")[0] == markup._array_view('{"a": [1]}')[0] == "none"


def test_redacted_values(spark):
    texts = ['{"api_key": "x", "a": [{"Access-Token": 5}, "password=hunter22 ok"], "n": null}', "no json", None, "[]", '"Bearer abcdefghijklmnop"']
    got = [tuple(r.r) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(markup.redacted_json("t").alias("r")).collect()]
    assert json.loads(got[0][0]) == {"api_key": "[REDACTED]", "a": [{"Access-Token": "[REDACTED]"}, "password=[REDACTED] ok"], "n": None} and got[0][1] == 3
    assert got[1:4] == [(None, 0), (None, 0), ("[]", 0)] and got[4][1] == 1


def test_span_matches(spark):
    examples = spark.createDataFrame([("e", "one two three four", [("fact", "one two"), ("fact", "two three"), ("goal", "four"), ("fact", "absent")])], "id string, current string, expected array<struct<memory_type:string,evidence_quote:string>>")
    said = [("c1", 1, "fact", 4, 13), ("c2", 2, "fact", 0, 7), ("c3", 3, "fact", 0, 7), ("c4", 4, "goal", 14, 15), ("c5", 5, "fact", 14, 18), ("c6", 6, "goal", None, None), ("c1", 1, "fact", 4, 13)]
    rows = spark.createDataFrame([(i, "e", o, t, a, b) for i, o, t, a, b in said], "id string, example_id string, ord bigint, memory_type string, evidence_start int, evidence_end int")
    # c1 overlaps both and takes the first, c2 the second by half of nothing less, c3 finds none free
    got = {r.id: r.gold for r in matching.matched_spans(rows, examples).collect()}
    assert got == walked(said, ["one two", "two three", "four"], "one two three four") and set(got) == {"c1", "c2", "c3", "c4", "c5"}


def walked(said, quotes, text):
    """The greedy rule by hand: fact spans 0 and 1, goal span 2."""
    spans = {n: ("goal" if n == 2 else "fact", text.index(q), text.index(q) + len(q)) for n, q in enumerate(quotes)}
    out = {}
    for name, _, kind, lo, hi in sorted(set(said), key=lambda r: (r[1], r[0])):
        if lo is None:
            continue
        out[name] = next((n for n, (k, a, b) in sorted(spans.items()) if k == kind and n not in out.values() and min(hi, b) - max(lo, a) >= 0.5 * min(hi - lo, b - a) > 0), None)
    return out


@pytest.mark.parametrize("parts", [1, 32])
def test_packing_of_a_hot_key(spark, monkeypatch, parts):
    """What the budget can reach is enough: the same choice as a walk over all rows."""
    import random

    monkeypatch.setattr(A, "PARTS", parts)
    rng = random.Random(6)
    data = [("hot" if i % 3 else "cold", f"i{i:04}", f"u{rng.randrange(300)}", rng.randint(1, 12), round(rng.random(), 3)) for i in range(900)]
    rows = spark.createDataFrame(data, "q string, id string, u string, cost int, rank double")
    got, prefix = {"hot": set(), "cold": set()}, {"hot": set(), "cold": set()}
    for r in A.breadth_within(rows, "q", "u", "cost", "rank", 40).collect():
        got[r.q].add(r.id)
    for r in A.prefix_within(rows, ["q"], [F.col("rank")], "cost", 40).collect():
        prefix[r.q].add(r.id)
    for key in got:
        own = sorted((r for r in data if r[0] == key), key=lambda r: (r[4], r[1]))
        left, taken, seen, spent, first = 40, set(), set(), 0, set()
        for turn in (True, False):
            for _, name, unit, cost, _ in own:
                if name in taken or turn and unit in seen:
                    continue
                seen.add(unit)
                if cost <= left:
                    left -= cost
                    taken.add(name)
        for _, name, _, cost, _ in own:
            spent += cost
            if spent > 40:
                break
            first.add(name)
        assert got[key] == taken and prefix[key] == first


def test_witness(spark):
    events = spark.createDataFrame([("a", 1, "e1", "h1"), ("a", 2, "e2", "h2"), ("b", 1, "e3", "h3"), ("c", 5, "e4", "h4"), ("d", 3, "e5", "h5"), ("d", 9, "e6", "h6"), ("e", 1, "e7", "h7")], "branch_id string, seq bigint, id string, chain_hash string")
    seen = spark.createDataFrame([("a", 1, "h1"), ("b", 1, "other"), ("c", 7, "h9"), ("d", 4, "h"), ("x", 1, "h")], "branch_id string, seen bigint, hash string")
    assert {r.branch_id: r.verdict for r in chain.witnessed(events, seen).collect()} == {"a": "extension", "b": "divergence", "c": "rollback", "d": "replacement", "e": "new"}


def test_linked_pieces(spark):
    rows = [("x", s, f"c{s}") for s in (1, 999, 1000, 5200)]
    frame = lambda r: spark.createDataFrame(r, "k string, seq bigint, content string")
    links = lambda r: {x.piece: x.link for x in chain.build(frame(r), "k").collect()}
    whole, without = links(rows), links([rows[0], rows[1], rows[3]])
    assert whole[0] == without[0] and whole[5] != without[5] and set(whole) == {0, 1, 5}


def test_governed_stream(spark, tmp_path):
    from tracelake.streaming import log_streams as S

    spark.createDataFrame([("b", n, "x" * 300) for n in range(60)], "branch_id string, seq bigint, content string").coalesce(1).write.parquet(f"{tmp_path}/event_log.parquet")
    got = sorted((r.seq, r.action) for r in S.drain(S.governed(S.source(spark, str(tmp_path), "event_log"), 4000, 20)).collect())
    # 100 tokens an event: an action is due at its share of the window, and again twenty positions later
    want = [(seq, action) for action, share in S.ACTIONS for seq in range(share * 40 // 100 - 1, 60, 20)]
    assert got == sorted(want)
