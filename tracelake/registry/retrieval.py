"""Retrieval arms, fusion and ranking over the log and the facts (r.., w05-w10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators import lineage as L
from tracelake.operators import retrieval as R
from tracelake.plans import ordered as O
from tracelake.registry import query
from tracelake.registry.texts import terms_sql
from tracelake.registry.visibility import SQL_SEEN, _leaf
from tracelake.sources.tables import SQL_LOG, SQL_MEMORIES, branches, log, memories, read

QUERY = "retrieval order packet"
MEMORY_QUERY = "три снимка"
AS_OF_US = "1706745600000000"  # 2024-02-01, in microseconds
WINDOW = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


def _bm25_sql(table: str, column: str, q: str) -> str:
    terms = R.query_terms(q)
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * {R.K1 + 1} / (tf{i} + {R.K1} * ({1 - R.B} + {R.B} * len_ / avg_))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"tk AS (SELECT *, regexp_extract_all(lower(coalesce({column}, '')), '{R.WORDS}') AS toks FROM {table}), tf AS (SELECT *, len(toks) AS len_, {tf} FROM tk), st AS (SELECT count(*) AS n, greatest(avg(len_), 1e-9) AS avg_, {df} FROM tf), bm AS (SELECT tf.*, {score} AS bm25 FROM tf, st WHERE {hit})"


def _age_days():
    return (F.lit(int(AS_OF_US)) - F.expr("unix_micros(cast(created_at as timestamp))")) / 86400000000.0


def _fresh(half_life: float = 30.0):
    return X.freshness(_age_days(), half_life)


_SQL_FRESH = f"exp(-ln(2) * greatest(({AS_OF_US} - epoch_us(created_at)) / 86400000000.0, 0) / 30.0)"


@query("r01_bm25_events", f"WITH {SQL_LOG}, {_bm25_sql('log', 'content', QUERY)} SELECT id, round(bm25, 6) AS score FROM bm")
def r01(spark, d):
    return R.bm25(log(spark, d), F.col("content"), QUERY).select("id", F.round("bm25", 6).alias("score"))


@query("r02_bm25_memories", f"WITH {SQL_MEMORIES}, {_bm25_sql('mem', 'content', MEMORY_QUERY)} SELECT id, round(bm25, 6) AS score FROM bm WHERE id NOT IN (SELECT supersedes_id FROM mem WHERE supersedes_id IS NOT NULL)")
def r02(spark, d):
    rows = memories(spark, d)
    return L.without_superseded(R.bm25(rows, F.col("content"), MEMORY_QUERY), rows).select("id", F.round("bm25", 6).alias("score"))


def _rel_sql(q: str, column: str = "content") -> str:
    wanted = "['" + "', '".join(dict.fromkeys(q.lower().split())) + "']"
    n = len(set(q.lower().split()))
    both = f"len(list_filter({wanted}, lambda x: list_contains({terms_sql(column)}, x)))"
    return f"least(1.0, 0.7 * {both} / {n} + 0.15 * sqrt({both} / greatest(len({terms_sql(column)}), 1)) + CASE WHEN contains(lower({column}), '{q.lower()}') THEN 0.15 ELSE 0 END)"


@query("r03_memory_score", f"WITH {SQL_MEMORIES} SELECT id, round(({_rel_sql(MEMORY_QUERY)} * 0.65 + {_SQL_FRESH} * 0.10 + (1 - risk) * 0.15 + 1 / (1 + retrieval_cost) * 0.10) * CASE WHEN initial_status = 'settled' THEN 1 ELSE 0.85 END, 6) AS score FROM mem WHERE content IS NOT NULL")
def r03(spark, d):
    relevance = X.lexical_relevance(MEMORY_QUERY, F.col("content"))
    trust = F.when(F.col("initial_status") == "settled", 1.0).otherwise(0.85)
    return memories(spark, d).where("content is not null").select("id", F.round(R.memory_score(relevance, _fresh(), F.col("risk"), F.col("retrieval_cost")) * trust, 6).alias("score"))


@query("r04_event_score", f"WITH {SQL_LOG} SELECT id, round({_rel_sql(QUERY)} * 0.85 + {_SQL_FRESH} * 0.15, 6) AS score FROM log WHERE content IS NOT NULL")
def r04(spark, d):
    return log(spark, d, "content is not null").select("id", F.round(R.event_score(X.lexical_relevance(QUERY, F.col("content")), _fresh()), 6).alias("score"))


@query("r05_fallback_scan", f"WITH {SQL_LOG}, s AS (SELECT id, seq, {_rel_sql(QUERY)} AS relevance FROM log WHERE content IS NOT NULL) SELECT id, round(relevance, 6) AS relevance FROM s WHERE round(relevance, 6) > 0.05")
def r05(spark, d):
    rows = log(spark, d, "content is not null").select("id", "seq", F.round(X.lexical_relevance(QUERY, F.col("content")), 6).alias("relevance"))
    return rows.where("relevance > 0.05").select("id", "relevance")


@query(
    "r06_nearest_vectors",
    "WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM q, embeddings e WHERE e.vec_id <> q.query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) SELECT query, id, round(score, 6) AS score, place FROM r WHERE place <= 10",
)
def r06(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    vectors = read(spark, d, "embeddings")
    return R.nearest(vectors, vectors.where("vec_id % 50 = 0")).select("query", "id", F.round("score", 6).alias("score"), "place")


_LO, _HI = f"epoch_us(TIMESTAMP '{WINDOW[0]}')", f"epoch_us(TIMESTAMP '{WINDOW[1]}')"
_SQL_TEMPORAL = f"""tp AS (SELECT id, greatest(0.0, 1 - abs(epoch_us(created_at) - ({_LO} + {_HI}) / 2) / (({_HI} - {_LO}) / 2)) AS score, least(CAST(floor((epoch_us(created_at) - {_LO}) * 8 / ({_HI} - {_LO})) AS BIGINT), 7) AS bucket
  FROM log WHERE kind IN ('message', 'tool_output') AND created_at >= TIMESTAMP '{WINDOW[0]}' AND created_at < TIMESTAMP '{WINDOW[1]}' ORDER BY score DESC, id LIMIT {R.TEMPORAL_POOL}),
tt AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS turn FROM tp), ta AS (SELECT id, score FROM tt ORDER BY turn, bucket LIMIT {R.TEMPORAL_KEEP})"""


def _temporal(spark, d):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in WINDOW)
    rows = log(spark, d, F.col("kind").isin("message", "tool_output"))
    return R.temporal_arm(rows, F.col("created_at"), start, end)


@query("r07_temporal_arm", f"WITH {SQL_LOG}, {_SQL_TEMPORAL} SELECT id, round(score, 6) AS score FROM ta")
def r07(spark, d):
    return _temporal(spark, d).select("id", F.round("score", 6).alias("score"))


_SQL_ARMS = f"""{_SQL_TEMPORAL}, {_bm25_sql('log', 'content', QUERY)}, ea AS (SELECT id, round(bm25, 9) AS score FROM bm),
fa AS (SELECT b.id, {_SQL_FRESH} AS score FROM bm b), arms AS (
  SELECT 'bm25' AS arm, id, row_number() OVER (ORDER BY score DESC, id) AS place FROM ea UNION ALL
  SELECT 'recent' AS arm, id, row_number() OVER (ORDER BY score DESC, id) AS place FROM fa UNION ALL
  SELECT 'temporal' AS arm, id, row_number() OVER (ORDER BY score DESC, id) AS place FROM ta),
fused AS (SELECT id, sum(1.0 / ({R.RRF_K} + place)) AS score, string_agg(arm, ',' ORDER BY arm) AS arms FROM arms WHERE place <= 200 GROUP BY 1)"""


def _fused(spark, d):
    hits = R.bm25(log(spark, d), F.col("content"), QUERY)
    return R.fuse({"bm25": hits.select("id", F.round("bm25", 9).alias("score")), "recent": hits.select("id", _fresh().alias("score")), "temporal": _temporal(spark, d)})


@query("r09_hybrid_search", f"WITH {SQL_LOG}, {_SQL_ARMS} SELECT id, round(score, 9) AS score, arms FROM fused")
def r09(spark, d):
    """Full-text, recency and temporal arms fused by reciprocal rank."""
    return _fused(spark, d).select("id", F.round("score", 9).alias("score"), "arms")


_SQL_RECENCY = f"greatest(0.1, 1 - (({AS_OF_US} - epoch_us(l.created_at)) / 86400000000.0) / 365)"


@query(
    "r10_boosted_search",
    f"WITH {SQL_LOG}, {_SQL_ARMS} SELECT f.id, round(f.score * (1 + 0.2 * ({_SQL_RECENCY} - 0.5)) * (1 + 0.2 * (CASE WHEN contains(arms, 'temporal') THEN 1 ELSE 0.5 END - 0.5)) * (1 + 0.1 * (CASE WHEN contains(arms, ',') THEN 1 ELSE 0.5 END - 0.5)), 9) AS score FROM fused f JOIN log l ON l.id = f.id",
)
def r10(spark, d):
    at = log(spark, d).select("id", "created_at")
    recency = F.greatest(F.lit(0.1), 1 - _age_days() / 365)
    temporal = F.when(F.contains("arms", F.lit("temporal")), 1.0).otherwise(0.5)
    support = F.when(F.contains("arms", F.lit(",")), 1.0).otherwise(0.5)
    return _fused(spark, d).join(at, "id").select("id", F.round(R.boost(F.col("score"), recency, temporal, support), 9).alias("score"))


@query("r11_filtered_hits", f"WITH {SQL_LOG}, {_bm25_sql('log', 'content', QUERY)} SELECT id FROM bm WHERE NOT (regexp_matches(content, '{X.FAILURE}') AND length(trim(content)) < 60)")
def r11(spark, d):
    """Hits without failures that say nothing but that something failed."""
    hits = R.bm25(log(spark, d), F.col("content"), QUERY)
    return hits.where(~(F.col("content").rlike(X.FAILURE) & (F.length(F.trim("content")) < 60))).select("id")


def _overlap_scorer(query_text: str, texts: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: the share of query words in each text, with a preference for short texts."""
    wanted = set(R.query_terms(query_text))
    return [len(wanted & set(R.query_terms(t))) / len(wanted) - len(t) / 1e5 for t in texts]


@query("r13_reranked_hits")
def r13(spark, d):
    hits = R.bm25(log(spark, d), F.col("content"), QUERY).orderBy(F.desc(F.round("bm25", 9)), "id").limit(50)
    return R.rerank(hits.select("id", "content"), QUERY, _overlap_scorer).select("id", F.round("rerank_score", 6).alias("rerank_score"))


@query("r15_promoted_sources", f"WITH {SQL_MEMORIES}, {_bm25_sql('mem', 'content', MEMORY_QUERY)} SELECT b.id, l.id AS event_id, l.seq, l.content FROM bm b JOIN log l ON l.id = b.source_event_id")
def r15(spark, d):
    hits = R.bm25(memories(spark, d), F.col("content"), MEMORY_QUERY).select("id", F.col("source_event_id").alias("event_id"))
    events = log(spark, d).select(F.col("id").alias("event_id"), "seq", "content")
    return hits.join(events, "event_id").select("id", "event_id", "seq", "content")


@query("r16_channel_health", f"WITH {SQL_LOG}, h AS (SELECT max(seq) AS head FROM log) SELECT origin_channel, max(CASE WHEN content IS NOT NULL THEN seq END) AS indexed_through, h.head - max(CASE WHEN content IS NOT NULL THEN seq END) AS lag, count(CASE WHEN content IS NULL THEN 1 END) AS failures, epoch_us(date_trunc('minute', max(CASE WHEN content IS NOT NULL THEN created_at END))) AS succeeded_us, arg_max(CASE WHEN content IS NULL THEN id END, CASE WHEN content IS NULL THEN seq END) AS last_failed FROM log, h GROUP BY origin_channel, h.head")
def r16(spark, d):
    """How far each channel is indexed, the minute of its last success and its last failure; an event without text fails."""
    rows = log(spark, d)
    head = rows.agg(F.max("seq").alias("head"))
    good, bad = F.col("content").isNotNull(), F.col("content").isNull()
    minute = F.unix_micros(F.date_trunc("minute", F.max(F.when(good, F.col("created_at")))).cast("timestamp"))
    per = rows.groupBy("origin_channel").agg(F.max(F.when(good, F.col("seq"))).alias("indexed_through"), F.count_if(bad).alias("failures"), minute.alias("succeeded_us"), F.max_by("id", F.when(bad, F.col("seq"))).alias("last_failed"))
    return per.crossJoin(F.broadcast(head)).select("origin_channel", "indexed_through", (F.col("head") - F.col("indexed_through")).alias("lag"), "failures", "succeeded_us", "last_failed")


@query(
    "r17_staleness",
    f"WITH {SQL_LOG}, c AS (SELECT id, unnest(files) AS file, seq FROM log WHERE kind = 'tool_output'), r AS (SELECT id, count(*) OVER (PARTITION BY file) - rank() OVER (PARTITION BY file ORDER BY seq) AS changes FROM c) SELECT id, max(changes) AS changes, CASE WHEN max(changes) >= 3 THEN 'possibly_stale' ELSE 'current' END AS status FROM r GROUP BY 1",
)
def r17(spark, d):
    """Tool results by how often their files were touched afterwards: counted by rank, not by pairs."""
    rows = log(spark, d, "kind = 'tool_output'").select("id", "seq", F.explode("files").alias("file"))
    through = O.with_running_sum(rows, ["file"], "seq", F.lit(1), "through")
    totals = rows.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    per = through.join(totals, "file").groupBy("id").agg(F.max(F.col("total") - F.col("through")).alias("changes"))
    return per.select("id", "changes", F.when(F.col("changes") >= 3, "possibly_stale").otherwise("current").alias("status"))


@query("w05_top_hits", f"WITH {SQL_LOG}, {_bm25_sql('log', 'content', QUERY)} SELECT id, seq FROM bm ORDER BY round(bm25, 9) DESC, seq DESC LIMIT 25")
def w05(spark, d):
    return R.bm25(log(spark, d), F.col("content"), QUERY).orderBy(F.desc(F.round("bm25", 9)), F.desc("seq")).limit(25).select("id", "seq")


@query("w06_positional_bonus", f"WITH {SQL_LOG}, {_bm25_sql('log', 'content', QUERY)}, p AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS place FROM bm) SELECT id, round(least(1.0, 0.5 + 0.08 / place), 6) AS score FROM p WHERE place <= 100")
def w06(spark, d):
    best = R.bm25(log(spark, d), F.col("content"), QUERY).orderBy(F.desc(F.round("bm25", 9)), "id").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("bm25", 9)), "id"))
    return best.select("id", F.round(F.least(F.lit(1.0), 0.5 + 0.08 / place), 6).alias("score"))


@query("w09_best_per_id", f"WITH {SQL_LOG}, a AS (SELECT id, 'event' AS source, round({_rel_sql(QUERY)}, 6) AS score FROM log WHERE content IS NOT NULL UNION ALL SELECT id, 'fresh', round({_SQL_FRESH}, 6) FROM log) SELECT id, max(score) AS score FROM a GROUP BY 1")
def w09(spark, d):
    rows = log(spark, d)
    lexical = rows.where("content is not null").select("id", F.round(X.lexical_relevance(QUERY, F.col("content")), 6).alias("score"))
    return lexical.unionByName(rows.select("id", F.round(_fresh(), 6).alias("score"))).groupBy("id").agg(F.max("score").alias("score"))


@query("r01_visible_hits", SQL_SEEN.rstrip() + f", txt AS (SELECT *, concat_ws(' ', content, array_to_string(files, ' ')) AS body FROM log), {_bm25_sql('txt', 'body', QUERY)} SELECT id, round(bm25, 6) AS score FROM bm WHERE id IN (SELECT id FROM seen) AND kind IN ('message', 'tool_output') AND created_at >= TIMESTAMP '{WINDOW[0]}'")
def r01_visible(spark, d):
    """Full-text hits in texts and file names that a branch sees, of two kinds and since an instant; the statistics are those of all events."""
    hits = R.bm25(log(spark, d), F.concat_ws(" ", "content", F.array_join("files", " ")), QUERY)
    hits = hits.where(F.col("kind").isin("message", "tool_output") & (F.col("created_at") >= F.lit(WINDOW[0]).cast("timestamp_ntz")))
    return L.visible(hits, L.lineage(branches(spark, d), _leaf(log(spark, d)))).select("id", F.round("bm25", 6).alias("score"))


@query("g34_exposures", f"WITH {SQL_LOG}, {_bm25_sql('log', 'content', QUERY)}, p AS (SELECT id, session_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS place FROM bm), t AS (SELECT * FROM p WHERE place <= 50) SELECT id, place, session_id, count(*) OVER (PARTITION BY session_id) AS of_session FROM t")
def g34(spark, d):
    """What a search shows: one row per hit with its place, and how many hits its session has."""
    best = R.bm25(log(spark, d), F.col("content"), QUERY).orderBy(F.desc(F.round("bm25", 9)), "id").limit(50)
    shown = best.agg(F.sort_array(F.collect_list(F.struct((-F.round("bm25", 9)).alias("order"), "id", "session_id"))).alias("hits"))
    rows = shown.select(F.posexplode("hits").alias("n", "h")).select("h.id", (F.col("n") + 1).alias("place"), "h.session_id")
    return rows.select("id", "place", "session_id", F.count(F.lit(1)).over(Window.partitionBy("session_id")).alias("of_session"))
