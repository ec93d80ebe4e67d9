"""Hash chains over the log.

Verification is parallel, because every row stores its predecessor's hash: rows
are compared inside ranges of ``seq`` and the ranges' ends with each other.
Building needs the predecessor's result, so each chain key is folded by itself in
pieces of bounded length, which are then linked by their digests.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans import ordered as O

SEQ_RANGE = 50_000
#: Positions of one piece of a built chain.
PIECE = 1_000


def verify(events: DataFrame) -> DataFrame:
    """(seq, id, fault): rows that break the chain.

    broken_link: ``previous_hash`` is not the hash of the row before; broken_hash: ``chain_hash`` is
    not the hash of ``previous_hash`` and ``content_hash``. A null ``previous_hash`` starts an import.
    """
    rows = events.select("seq", "id", "previous_hash", "content_hash", "chain_hash", F.floor(F.col("seq") / SEQ_RANGE).alias("part"))
    inside = F.lag("chain_hash").over(Window.partitionBy("part").orderBy("seq"))
    ends = rows.groupBy("part").agg(F.max_by("chain_hash", "seq").alias("end"))
    # one row per range reaches this window
    carried = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("carried"))
    linked = rows.withColumn("inside", inside).join(carried, "part").withColumn("before", F.coalesce("inside", "carried"))
    link = F.col("previous_hash").isNotNull() & F.col("before").isNotNull() & (F.col("previous_hash") != F.col("before"))
    body = F.sha2(F.concat(F.coalesce("previous_hash", F.lit("")), "content_hash"), 256) != F.col("chain_hash")
    fault = F.when(link, "broken_link").when(body & F.col("previous_hash").isNotNull(), "broken_hash")
    return linked.select("seq", "id", fault.alias("fault")).where("fault is not null")


def witnessed(events: DataFrame, seen: DataFrame) -> DataFrame:
    """(branch_id, verdict): branches against what a witness has (branch_id, seen, hash) of their heads.

    new: not witnessed; rollback: the head lies before the witnessed one; replacement: its row is gone;
    divergence: its row has another hash; else unchanged or extension.
    """
    heads = events.groupBy("branch_id").agg(F.max("seq").alias("head")).join(seen, "branch_id", "left")
    now = events.select("branch_id", F.col("seq").alias("seen"), "id", "chain_hash")
    both = heads.join(now, ["branch_id", "seen"], "left")
    verdict = (
        F.when(F.col("seen").isNull(), "new")
        .when(F.col("head") < F.col("seen"), "rollback")
        .when(F.col("id").isNull(), "replacement")
        .when(~F.col("chain_hash").eqNullSafe(F.col("hash")), "divergence")
        .when(F.col("head") == F.col("seen"), "unchanged")
        .otherwise("extension")
    )
    return both.select("branch_id", verdict.alias("verdict"))


def build(events: DataFrame, key: str) -> DataFrame:
    """(chain, piece, n, digest, link): each chain's rows folded in order of seq, piece by piece, and the pieces linked.

    Pieces are folded side by side, each from its own number; ``link`` is the digest of a piece's digest and that of the
    piece before it, so that a piece that is lost or exchanged breaks the link behind it. Null content counts as empty.
    """
    rows = events.select(F.coalesce(key, F.lit("")).alias("chain"), F.floor(F.col("seq") / PIECE).cast("bigint").alias("piece"), "seq", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        now = str(group["piece"].iloc[0])
        for digest in group.sort_values("seq")["digest"]:
            now = hashlib.sha256((now + digest).encode()).hexdigest()
        return pd.DataFrame({"chain": [group["chain"].iloc[0]], "piece": [group["piece"].iloc[0]], "n": [len(group)], "digest": [now]})

    pieces = rows.groupBy("chain", "piece").applyInPandas(fold, "chain string, piece bigint, n bigint, digest string")
    # one row per piece: by ranges of its number, as a chain may have very many
    linked = O.with_previous(pieces, ["chain"], "piece", "digest", "before")
    return linked.select("chain", "piece", "n", "digest", F.sha2(F.concat(F.coalesce("before", F.lit("")), "digest"), 256).alias("link"))
