"""Branch lineage, visibility and time travel over the log.

Defined results: branches whose chain runs into a cycle have no lineage; a null
fork does not cut anything off; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans.cut import cut, cut_counting

#: Width of the ranges of ``seq`` inside which rows of one key are sorted.
SEQ_RANGE = 50_000


def lineage(branches: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(branch, ancestor, cutoff, distance) of the branches (node, parent, fork), or of the ``wanted`` (branch).

    ``cutoff`` is the least fork position on the way up, null for the branch itself. For all branches steps
    are doubled, so a chain of depth n takes log n joins; from wanted branches the walk goes up.
    """
    if wanted is not None:
        return _lineage_of(branches, wanted)
    jump = cut(branches.where("parent is not null").select("node", F.col("parent").alias("far"), F.col("fork").alias("cut")))
    reach = branches.select(F.col("node").alias("branch"), F.col("node").alias("ancestor"), F.lit(None).cast("bigint").alias("cutoff"), F.lit(0).cast("bigint").alias("distance"))
    reach, step, size, left = cut(reach), 1, branches.count(), True
    while step <= size and left:
        more = reach.join(jump, reach["ancestor"] == jump["node"]).select("branch", F.col("far").alias("ancestor"), F.least("cutoff", "cut").alias("cutoff"), (F.col("distance") + step).alias("distance"))
        reach = cut(reach.unionByName(more), replaces=reach)
        ahead = jump.select(F.col("node").alias("far"), F.col("far").alias("farther"), F.col("cut").alias("cut2"))
        jump, left = cut_counting(jump.join(ahead, "far").select("node", F.col("farther").alias("far"), F.least("cut", "cut2").alias("cut")), F.lit(True), replaces=jump)
        step *= 2
    # whoever can still jump after more steps than there are branches runs in circles
    return reach.join(jump.select(F.col("node").alias("branch")), "branch", "left_anti")


#: Steps of the walk up from wanted branches between two written tables.
WALK_STEPS = 8


def _lineage_of(branches: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lineage`` of wanted branches: each row carries its way up and looks up one parent after the other."""
    up = cut(branches.select(F.col("node").alias("at"), "parent", "fork"))
    none = F.lit(None).cast("bigint")
    way = F.array(F.struct(F.col("branch").alias("ancestor"), none.alias("cutoff"), F.lit(0).cast("bigint").alias("distance")))
    walk, left = cut(wanted.select("branch").distinct().join(up.select(F.col("at").alias("branch")), "branch", "left_semi").select("branch", F.col("branch").alias("at"), way.alias("way"), F.lit(False).alias("circle"))), True
    while left:
        moved = walk
        for _ in range(WALK_STEPS):
            moved = moved.join(up, "at", "left")
            top = F.element_at("way", -1)
            further = F.struct(F.col("parent").alias("ancestor"), F.least(top["cutoff"], F.col("fork")).alias("cutoff"), (top["distance"] + 1).alias("distance"))
            again = F.coalesce(F.array_contains(F.transform("way", lambda w: w["ancestor"]), F.col("parent")), F.lit(False))
            moved = moved.select("branch", F.when(~again, F.col("parent")).alias("at"), F.when(F.col("parent").isNull() | again, F.col("way")).otherwise(F.array_append("way", further)).alias("way"), (F.col("circle") | again).alias("circle"))
        walk, left = cut_counting(moved, F.col("at").isNotNull(), replaces=walk)
    return walk.where("not circle").select("branch", F.explode("way").alias("w")).select("branch", "w.ancestor", "w.cutoff", "w.distance")


def visible(rows: DataFrame, lines: DataFrame, branch_col: str = "branch_id", cursor_col: str = "seq") -> DataFrame:
    """Rows that each branch of ``lines`` sees: (branch, *rows)."""
    lines = lines.select("branch", F.col("ancestor").alias("_ancestor"), F.col("cutoff").alias("_cutoff"))
    seen = rows.join(lines, F.lower(F.trim(rows[branch_col])) == F.col("_ancestor"))
    return seen.where(F.col("_cutoff").isNull() | (F.col(cursor_col) <= F.col("_cutoff"))).select("branch", *rows.columns)


def last_at(points: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """As-of: ``points`` with ``last``, the greatest ``at`` among ``rows`` of the same key that is not over the point's.

    Keys are cut into ranges of ``at``; what lies before a range comes from the ranges' maxima,
    so that a key with a third of all rows is spread over many tasks.
    """
    part = F.floor(F.col(at) / SEQ_RANGE)
    both = points.withColumn("_row", F.lit(None).cast("bigint")).unionByName(rows.select(key, at).distinct().withColumn("_row", F.col(at).cast("bigint")), allowMissingColumns=True).withColumn("_part", part)
    inside = Window.partitionBy(key, "_part").orderBy(F.col(at), F.col("_row").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    tops = both.groupBy(key, "_part").agg(F.max("_row").alias("_top"))
    carry = tops.select(key, "_part", F.max("_top").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = both.withColumn("_in", F.max("_row").over(inside)).where("_row is null").join(carry, [key, "_part"])
    return out.select(*points.columns, F.coalesce("_in", "_carry").alias("last"))


def fork_violations(branches: DataFrame, lines: DataFrame, events: DataFrame) -> DataFrame:
    """(branch, parent, fork, tip): branches whose fork lies before 0 or after all that their parent sees."""
    forks = branches.where("parent is not null and fork is not null")
    seen = lines.join(forks.select(F.col("parent").alias("branch")).distinct(), "branch", "left_semi")
    top = F.lit((1 << 62)).cast("bigint")
    points = seen.select("branch", F.col("ancestor").alias("key"), F.coalesce("cutoff", top).alias("seq"))
    tips = last_at(points, events.select(F.lower(F.trim("branch_id")).alias("key"), "seq"), "key", "seq").groupBy("branch").agg(F.coalesce(F.max("last"), F.lit(0)).alias("tip"))
    out = forks.join(tips, forks["parent"] == tips["branch"]).where("fork < 0 or fork > tip")
    return out.select(forks["node"].alias("branch"), "parent", "fork", "tip")


def known_at(events: DataFrame, instant: Column) -> DataFrame:
    """One row ``cutoff``: the last position recorded by ``instant``, 0 if none."""
    return events.where(F.col("created_at") <= instant).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("cutoff"))


def without_superseded(rows: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Rows that no row of ``by`` supersedes. ``by`` is the rows themselves (a successor that was
    filtered out hides nothing) or, for search, all visible rows."""
    over = (rows if by is None else by).where("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct()
    return rows.join(over, "id", "left_anti")


def versions(memories: DataFrame) -> DataFrame:
    """(id, ancestor, steps): every fact with all facts that it supersedes, itself included; steps are doubled.

    Facts whose chain runs in circles have no history and do not come out.
    """
    jump, left = cut_counting(memories.where("supersedes_id is not null").select("id", F.col("supersedes_id").alias("far")), F.lit(True))
    reach, step, size = memories.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("steps")), 1, left
    before = None
    while left and step <= size:
        more = reach.join(jump.withColumnRenamed("id", "_at"), F.col("ancestor") == F.col("_at")).select("id", F.col("far").alias("ancestor"), (F.col("steps") + step).alias("steps"))
        reach = cut(reach.unionByName(more), replaces=before)
        before = reach
        ahead = jump.select(F.col("id").alias("far"), F.col("far").alias("farther"))
        jump, left = cut_counting(jump.join(ahead, "far").select("id", F.col("farther").alias("far")), F.lit(True), replaces=jump)
        step *= 2
    # after more steps than there are links only circles are left
    return reach.join(jump.select("id"), "id", "left_anti") if left else reach


def ancestor_as_of(memories: DataFrame, cutoff: Column) -> DataFrame:
    """(id, as_of_id): the first version down the chain that was already there at ``cutoff``."""
    chain = versions(memories).join(memories.select(F.col("id").alias("ancestor"), "cursor_seq"), "ancestor")
    return chain.where(F.col("cursor_seq") <= cutoff).groupBy("id").agg(F.min_by("ancestor", "steps").alias("as_of_id"))


def active_blocks(events: DataFrame) -> DataFrame:
    """(branch_id, id, seq, content): the last protected block written on each branch."""
    blocks = events.where("kind = 'memory_block'")
    return blocks.groupBy("branch_id").agg(F.max(F.struct("seq", "id", "content")).alias("b")).select("branch_id", "b.id", "b.seq", "b.content")


def common_trace(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): the value that all rows of a key share, null if they differ; null is a value of its own."""
    agree = (F.count_distinct(column) == 1) & (F.count(column) == F.count(F.lit(1)))
    return rows.groupBy(key).agg(F.when(agree, F.max(column)).alias(column))
