"""Every entity of an event comes out, however many there are."""

from tracelake import catalog


def test_no_entity_is_dropped(spark, tmp_path):
    names = [f"src/part_{n:02}.py" for n in range(30)]
    spark.createDataFrame([(1, "a", " ".join(names[::-1]) + " SRC/part_00.py"), (2, "b", None), (3, "c", "nothing")], "seq bigint, id string, content string").createOrReplaceTempView("said")
    other = ["branch_id", "session_id", "kind", "role", "origin_channel", "origin_adapter", "payload_json", "previous_hash", "content_hash", "chain_hash"]
    nulls = ", ".join(f"cast(null as string) as {c}" for c in other)
    spark.sql(f"select *, {nulls}, cast(null as array<string>) as files, cast(null as timestamp_ntz) as created_at from said").write.parquet(f"{tmp_path}/event_log.parquet")
    got = catalog.queries()["f29_entities"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.entity) for r in got) == [("a", n) for n in names]
