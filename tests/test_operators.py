"""Lineage, retrieval, assembly, chains and streams on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import assembly as A
from tracelake.operators import chain, retrieval
from tracelake.operators import lineage as L
from tracelake.streaming import log_streams as S


def test_three_generation_lineage(spark):
    branches = spark.createDataFrame([("main", None, None), ("b1", "main", 60), ("b2", "b1", 80), ("b3", "b2", 50), ("x", "y", 1), ("y", "x", 1)], "node string, parent string, fork bigint")
    lines = L.lineage(branches)
    got = {(r.branch, r.ancestor): r.cutoff for r in lines.collect()}
    assert got == {("main", "main"): None, ("b1", "b1"): None, ("b1", "main"): 60, ("b2", "b2"): None, ("b2", "b1"): 80, ("b2", "main"): 60, ("b3", "b3"): None, ("b3", "b2"): 50, ("b3", "b1"): 50, ("b3", "main"): 50}
    events = spark.createDataFrame([("main", 10), ("main", 70), ("b1", 75), ("b1", 90), ("b2", 85)], "branch_id string, seq bigint")
    seen = {}
    for r in L.visible(events, lines).collect():
        seen.setdefault(r.branch, set()).add(r.seq)
    assert seen == {"main": {10, 70}, "b1": {10, 75, 90}, "b2": {10, 75, 85}, "b3": {10}}
    only = L.lineage(branches, spark.createDataFrame([("b2",)], "branch string"))
    assert {(r.ancestor, r.distance) for r in only.collect()} == {("b2", 0), ("b1", 1), ("main", 2)}


def test_superseded_variants(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "a", 2)], "id string, supersedes_id string, n int")
    assert [r.id for r in L.without_superseded(rows.where("n = 1")).collect()] == ["a"]
    assert L.without_superseded(rows.where("n = 1"), rows).count() == 0


def test_fusion_by_hand(spark):
    arm = lambda *ids: spark.createDataFrame([(i, float(-n)) for n, i in enumerate(ids)], "id string, score double")
    got = {r.id: (round(r.score, 9), r.arms) for r in retrieval.fuse({"x": arm("a", "b"), "y": arm("b")}).collect()}
    assert got == {"a": (round(1 / 61, 9), "x"), "b": (round(1 / 62 + 1 / 61, 9), "x,y")}


def test_bm25_edges(spark):
    rows = spark.createDataFrame([(1, "Snapshot of a Snapshot"), (2, None), (3, ""), (4, "other words")], "id int, content string")
    hits = retrieval.bm25(rows, F.col("content"), "snapshot").collect()
    assert [r.id for r in hits] == [1] and hits[0].bm25 > 0
    assert retrieval.bm25(rows, F.col("content"), "").count() == 0
    assert retrieval.bm25(rows.limit(0), F.col("content"), "snapshot").count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", block)
    monkeypatch.setattr(retrieval, "VECTOR_QUERIES", 3)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 6))
    m[5] = m[6]  # a tie
    data = [(i, v.tolist()) for i, v in enumerate(m)] + [(90, None), (91, [0.0] * 6), (92, [1.0, 2.0])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = {}
    for r in retrieval.nearest(vectors, vectors.where("vec_id % 10 = 0"), 4).collect():
        got.setdefault(r["query"], {})[r.place] = r.id
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 10, 20, 30):
        s = u @ u[q]
        order = sorted((i for i in range(40) if i != q), key=lambda i: (-s[i], i))[:4]
        assert [got[q][p] for p in (1, 2, 3, 4)] == order
    assert 90 not in got


def test_reranker_failure_keeps_hits(spark):
    hits = spark.createDataFrame([("a", "x"), ("b", None)], "id string, content string")

    def broken(query, texts):
        raise RuntimeError("down")

    assert {(r.id, r.rerank_score) for r in retrieval.rerank(hits, "x", broken).collect()} == {("a", None), ("b", None)}


def test_breadth_packing(spark):
    rows = spark.createDataFrame([("q", "a1", "s1", 5, 1.0), ("q", "a2", "s1", 2, 2.0), ("q", "b1", "s2", 9, 3.0), ("q", "c1", "s3", 3, 4.0)], "q string, id string, s string, cost int, rank double")
    got = {r.id for r in A.breadth_within(rows, "q", "s", "cost", "rank", 10).collect()}
    assert got == {"a1", "c1", "a2"}


def test_chain_faults(spark):
    rows, before = [], None
    for seq in range(1, 9):
        content = hashlib.sha256(str(seq).encode()).hexdigest()
        now = hashlib.sha256(((before or "") + content).encode()).hexdigest()
        rows.append([seq, f"e{seq}", before, content, now])
        before = now
    schema = "seq bigint, id string, previous_hash string, content_hash string, chain_hash string"
    assert chain.verify(spark.createDataFrame([tuple(r) for r in rows], schema)).count() == 0
    rows[3][3] = "0" * 64
    rows[6][2] = "1" * 64
    assert {(r.seq, r.fault) for r in chain.verify(spark.createDataFrame([tuple(r) for r in rows], schema)).collect()} == {(4, "broken_hash"), (7, "broken_link")}
    assert chain.verify(spark.createDataFrame([], schema)).count() == 0


def test_streams_over_several_batches(spark, tmp_path):
    rows = [("s1", "message", f"text {i % 3}", f"2024-01-0{1 + i % 2} 00:00:00", i) for i in range(9)] + [(None, "message", "x", "2024-01-01 00:00:00", 9)]
    frame = spark.createDataFrame(rows, "session_id string, kind string, content string, at string, seq int").withColumn("created_at", F.col("at").cast("timestamp_ntz")).drop("at")
    frame.repartition(3).write.parquet(str(tmp_path / "event_log.parquet"))
    stream = S.source(spark, str(tmp_path), "event_log")
    assert S.drain(S.once_per_receipt(stream)).count() == 6
    totals = S.drain(S.cumulative_counts(stream)).groupBy("session_id").agg(F.max("events").alias("n"), F.max("bytes").alias("b")).collect()
    assert [(r.session_id, r.n, r.b) for r in totals] == [("s1", 9, 54)]


def test_lineage_of_wanted_branches(spark):
    tree = spark.createDataFrame([("root", None, None), *[(f"b{i}", f"b{i - 1}" if i else "root", 100 - i) for i in range(20)], ("c1", "c2", 1), ("c2", "c1", 2), ("lost", "gone", 5)], "node string, parent string, fork bigint")
    whole = {(r.branch, r.ancestor, r.cutoff, r.distance) for r in L.lineage(tree).collect()}
    wanted = spark.createDataFrame([("b19",), ("root",), ("c1",), ("lost",), ("never",), (None,)], "branch string")
    got = {(r.branch, r.ancestor, r.cutoff, r.distance) for r in L.lineage(tree, wanted).collect()}
    assert got == {x for x in whole if x[0] in ("b19", "root", "c1", "lost")} and len(got) == 21 + 1 + 2


def test_versions_end_on_cycles(spark):
    facts = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "a", 1), ("d", "a", 4), ("x", "y", 2), ("y", None, 1)], "id string, supersedes_id string, cursor_seq bigint")
    assert {(r.id, r.ancestor, r.steps) for r in L.versions(facts).collect()} == {("x", "x", 0), ("x", "y", 1), ("y", "y", 0)}
    assert L.versions(facts.limit(0)).count() == 0
