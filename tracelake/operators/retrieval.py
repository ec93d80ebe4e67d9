"""Retrieval arms, fusion and ranking.

Every arm gives (id, score) and more columns; arms are united and fused in one
plan, so that Spark sees the whole pipeline. Queries are fixed texts: their terms
are counted inside each row, and only three numbers per query cross the network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
TEMPORAL_POOL, TEMPORAL_KEEP, TEMPORAL_BUCKETS = 60, 10, 8
WORDS = r"[\p{L}\p{N}]+"
#: Rows and queries of one block of the exact vector search.
VECTOR_ROWS, VECTOR_QUERIES = 4096, 512


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def bm25(rows: DataFrame, text: Column, query: str) -> DataFrame:
    """``rows`` that hold a query term, with ``bm25``; the statistics are those of all rows.

    Rows without text count as empty; a query without terms gives no rows.
    """
    terms = query_terms(query)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))
    counted = rows.withColumn("_tokens", tokens)

    def times(term: str) -> Column:
        return F.size(F.filter("_tokens", lambda x: x == term))

    counted = counted.select(*rows.columns, F.size("_tokens").alias("_len"), *[times(t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.avg("_len"), F.lit(1e-9)).alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("bigint")).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.ln((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"_tf{i}") > 0)
    return counted.where(hit).crossJoin(F.broadcast(stats)).select(*rows.columns, score.alias("bm25"))


def memory_score(relevance: Column, freshness: Column, risk: Column, cost: Column) -> Column:
    """Weighted mean of relevance .65, freshness .10, safety .15 and cheapness .10."""
    return relevance * 0.65 + freshness * 0.10 + (1 - risk) * 0.15 + 1 / (1 + cost) * 0.10


def event_score(relevance: Column, freshness: Column) -> Column:
    return relevance * 0.85 + freshness * 0.15


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def temporal_arm(rows: DataFrame, at: Column, start: Column, end: Column) -> DataFrame:
    """(id, score): rows inside a window, nearest to its middle first, picked in turn from time buckets."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    lo, hi, t = micros(start), micros(end), micros(at)
    middle, half = (lo + hi) / 2, (hi - lo) / 2
    near = F.greatest(F.lit(0.0), 1 - F.abs(t - middle) / half)
    pool = rows.where((at >= start) & (at < end)).select("id", near.alias("score"), F.least(F.floor((t - lo) * TEMPORAL_BUCKETS / (hi - lo)), F.lit(TEMPORAL_BUCKETS - 1)).alias("bucket"))
    pool = pool.orderBy(F.desc("score"), "id").limit(TEMPORAL_POOL)
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "id"))
    return pool.withColumn("turn", turn).orderBy("turn", "bucket").limit(TEMPORAL_KEEP).select("id", "score")


def fuse(arms: dict[str, DataFrame], depth: int = 200) -> DataFrame:
    """(id, score, arms): reciprocal rank fusion of arms (id, score), each cut to its best ``depth`` first."""
    ranked = None
    for name, arm in arms.items():
        best = arm.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(depth)
        # at most ``depth`` rows reach this window
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        part = best.select("id", F.lit(name).alias("arm"), (1.0 / (RRF_K + place)).alias("part"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("id").agg(F.sum("part").alias("score"), F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("arms"))


def boost(score: Column, recency: Column, temporal: Column, support: Column) -> Column:
    """Multiplicative boosts around one half: recency .2, temporal .2, support .1."""
    return score * (1 + 0.2 * (recency - 0.5)) * (1 + 0.2 * (temporal - 0.5)) * (1 + 0.1 * (support - 0.5))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query, id, score): the k rows of greatest cosine for each query row, itself left out, exactly.

    Rows and queries are cut into blocks, each pair of blocks is one matrix product in one task, and
    the best k per block are merged. Null vectors, vectors of length zero and of another size than the
    query's match nothing.
    """
    counts = vectors.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / VECTOR_ROWS)).alias("row_blocks")).crossJoin(queries.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / VECTOR_QUERIES)).alias("query_blocks")))
    rows = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).crossJoin(F.broadcast(counts))
    rows = rows.withColumn("rb", F.pmod(F.xxhash64("id"), "row_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_blocks") - 1))).select("rb", "qb", "id", "v")
    asked = queries.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).crossJoin(F.broadcast(counts))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), "query_blocks")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_blocks") - 1))).select("rb", "qb", "id", "v")

    def unit(frame: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes = frame["v"].map(lambda v: 0 if v is None else len(v))
        out = {}
        for size, part in frame[sizes > 0].groupby(sizes):
            m = np.vstack(part["v"].to_numpy())
            norm = np.linalg.norm(m, axis=1)
            keep = norm > 0
            out[size] = (part["id"].to_numpy()[keep], m[keep] / norm[keep, None])
        return out

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows_by, found = unit(left), []
        for size, (ids, q) in unit(right).items():
            if size not in rows_by:
                continue
            names, m = rows_by[size]
            scores = q @ m.T
            for i, query in enumerate(ids):
                own = np.where(names == query, -np.inf, scores[i])
                best = np.lexsort((names, -own))[:k] if len(own) <= 4 * k else None
                if best is None:
                    edge = np.partition(own, len(own) - k)[len(own) - k]
                    near = np.flatnonzero(own >= edge)
                    best = near[np.lexsort((names[near], -own[near]))][:k]
                found += [(query, names[j], own[j]) for j in best if own[j] > -np.inf]
        return pd.DataFrame(found, columns=["query", "id", "score"])

    local = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(product, "query bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return local.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "score", "place")


def rerank(hits: DataFrame, query: str, scorer) -> DataFrame:
    """``hits`` (id, content, ...) with ``rerank_score``: a scorer (query, texts) -> scores runs once per Arrow
    batch on the first 2000 characters; where it fails the score is null and the fused order stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                scores = list(scorer(query, batch["content"].fillna("").str.slice(0, 2000).tolist()))
            except Exception:  # a plugin's failure never fails a query
                scores = [None] * len(batch)
            yield pd.DataFrame({"id": batch["id"], "rerank_score": pd.Series(scores, dtype="float64", index=batch.index)})

    scored = hits.select("id", "content").mapInPandas(run, "id string, rerank_score double")
    return hits.join(scored, "id")
