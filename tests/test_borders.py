"""g01 and s06 look over a whole session or branch: rows on both sides of a border of the ranged windows."""

from tests import oracle
from tracelake import catalog

# 50,000 is the width of a range
TURNS = [(10, "user"), (20, "assistant"), (49_999, "user"), (50_001, "assistant"), (50_002, "user"), (120_000, "assistant")]
COLUMNS = "seq bigint, id string, branch_id string, session_id string, kind string, role string, origin_channel string, origin_adapter string, content string, payload_json string, files array<string>, created_at timestamp_ntz, previous_hash string, content_hash string, chain_hash string"


def written(spark, folder):
    rows = [(seq, f"{key}{seq}", key, key, "message", role, *[None] * 9) for key in "ab" for seq, role in TURNS]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/event_log.parquet")
    return str(folder)


def test_groups_go_on_over_borders(spark, tmp_path):
    got = {r.id: r.grp for r in catalog.queries()["g01_interaction_groups"](spark, written(spark, tmp_path)).collect()}
    assert got == {f"{key}{seq}": grp for key in "ab" for (seq, _), grp in zip(TURNS, (1, 1, 2, 2, 3, 3))}


def test_preceding_events_over_borders(spark, tmp_path):
    got = {r.id: (r.before_1, r.before_2) for r in catalog.queries()["s06_preceding_events"](spark, written(spark, tmp_path)).collect()}
    for key in "ab":
        ids = [None, None, *(f"{key}{seq}" for seq, _ in TURNS)]
        assert [got[x] for x in ids[2:]] == [(ids[i + 1], ids[i]) for i in range(len(TURNS))]


def test_equal_plain_windows_over_a_table_with_borders(spark):
    """The tables of scale 0.1 have 60,500 rows, with a border at 50,000; windows over whole sessions and branches are the measure."""
    data = oracle.DATA.parent / "sf0.1"
    log = "WITH log AS (SELECT seq, id, branch_id, session_id, kind, lower(trim(role)) AS role FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM event_log) WHERE nth = 1) "
    con = oracle.connection(data)
    groups = log + "SELECT id, CAST(sum(CASE WHEN kind = 'message' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS grp FROM log WHERE session_id IS NOT NULL"
    oracle.compare(spark, con, catalog.queries()["g01_interaction_groups"], groups, data)
    before = log + "SELECT id, lag(id, 1) OVER w AS before_1, lag(id, 2) OVER w AS before_2 FROM log WHERE kind = 'message' AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY branch_id ORDER BY seq)"
    oracle.compare(spark, con, catalog.queries()["s06_preceding_events"], before, data)
