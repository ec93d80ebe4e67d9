"""File sources and sinks, and text with nested structure."""

import json

from pyspark.sql import functions as F

from tracelake.operators import chain, markup
from tracelake.sources import files


def test_questions(spark, tmp_path):
    data = [{"question_id": "q1", "question_type": "t", "question": "?", "answer": "a", "haystack_dates": ["d1", "d2"], "haystack_session_ids": ["s1", ""], "haystack_sessions": [[{"role": "user", "content": "x"}], []]}, {"question_id": "q2"}]
    (tmp_path / "q.json").write_text(json.dumps(data))
    rows = files.questions(spark, str(tmp_path / "q.json")).orderBy("position").collect()
    assert [(r.question_id, r.session_id, r.date, len(r.turns)) for r in rows] == [("q1", "s1", "d1", 1), ("q1", "session_1", "d2", 0)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    assert {(r.a, r._corrupt) for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()} == {(1, None), (None, "broken")}


def test_fingerprints(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    rows = files.fingerprints(spark, str(tmp_path), "*.py").collect()
    assert [(r.path, r.length, r.sha256[:8]) for r in rows] == [("src/a.py", 1, "2d711642")]


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, v int")
    path = str(tmp_path / "t")
    assert [files.append_once(rows, path, "k"), files.append_once(rows, path, "k")] == [2, 0]
    assert files.append_once(spark.createDataFrame([("c", 4)], "k string, v int"), path, "k") == 1
    latest = files.latest_by_key(spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "k string, n int, v string"), "k", "n")
    assert [tuple(r) for r in latest.collect()] == [("x", 2, "new")]


def test_markup(spark):
    texts = ["a <private>b <private x='>'>c</private> d</private> e", "x <private>open", "<private/>y", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.text, r.regions) for r in rows.select("i", markup.without_private("t").alias("p")).select("i", "p.*").collect()}
    assert got == {0: ("a [PRIVATE] e", 1), 1: ("x [PRIVATE]", 1), 2: ("<private/>y", 0), 3: (None, 0), 4: ("", 0)}
    zones = spark.createDataFrame([("one `two`\n> three\n```\ncode\n```\nend",)], "t string").select(markup.zone_sizes("t").alias("z")).select("z.*").first()
    assert tuple(zones) == (7, 10, 7, 5)
    csv = spark.createDataFrame([('[{"a": 1, "b": "x,y"}, {"a": 2, "b": null}]',), ('[{"a": 1}, {"b": 2}]',), ("no",), (None,)], "t string").select(markup.lossless_csv("t").alias("c")).collect()
    assert [r.c for r in csv] == ['"a","b"\n1,"x,y"\n2,null', None, None, None]


def test_built_chain(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5000, "y")], "branch_id string, seq bigint, content string")
    built = {(r.chain, r.piece): (r.n, r.digest) for r in chain.build(rows, "branch_id").collect()}
    changed = {(r.chain, r.piece): r.digest for r in chain.build(rows.withColumn("content", F.when(F.col("seq") == 2, "z").otherwise(F.col("content"))), "branch_id").collect()}
    assert {k: n for k, (n, _) in built.items()} == {("a", 0): 2, ("b", 5): 1}
    assert changed["a", 0] != built["a", 0][1] and changed["b", 5] == built["b", 5][1]
