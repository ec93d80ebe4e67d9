"""Parent-child rows to full hierarchies.

Leaves are peeled with multiplied steps (round k removes 4**k layers at once), which
leaves exactly the roots and the cycles. Every remaining tree is written as an
Euler tour, one entry and one exit element per node, and the tour is ranked by
parallel pointer jumping. The entry and exit positions then give depth, root,
ancestors, paths and descendants.

Defined results: ids are compared without case and outer blanks; null or blank
ids are ignored; a blank parent is no parent; repeated rows count once, and if
they disagree on the parent the greatest wins; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans.cut import cut, cut_counting

#: Children of one parent are chained in this many parts, so that a parent with
#: a third of all rows is not sorted by one task.
SIBLING_PARTS = 64

#: Pointers followed in one round, all looked up in the same table: a round multiplies the steps seen by one more than
#: this, for as many joins but only one written table.
JUMPS = 3

TREE, CYCLE, MISSING = "tree", "cycle", "missing"


def node_key(column: Column) -> Column:
    """Comparison form of an id: without outer blanks and case; null if nothing is left."""
    key = F.lower(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(key != "", key)


def links(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row (node, parent) per distinct id."""
    return (
        rows.select(node_key(F.col(id_col)).alias("node"), node_key(F.col(parent_col)).alias("parent"))
        .where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.max("parent").alias("parent"))
    )


def expose_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on cycles: (node, label), label the smallest id of the node's cycle.

    ``edges`` has (node, parent). Nodes whose chain ends leave the loop as soon
    as they see an end, so that the pointers to a popular root are never joined.
    """
    ends = edges.join(edges.select(F.col("node").alias("parent")), "parent", "left_anti").select("node")
    first = edges.join(ends.withColumn("done", F.lit(True)), "node", "left").select("node", F.when(F.col("done"), F.col("node")).otherwise(F.col("parent")).alias("ptr"), F.coalesce("done", F.lit(False)).alias("done"))
    running = ~F.col("done")
    step, now = cut_counting(first, running)
    before = -1
    # as long as chains end, each round sees some of them end
    while now and (now != before or step.where(running).count() != before):
        ahead, moved = step.select(F.col("node").alias("key"), F.col("ptr").alias("far"), F.col("done").alias("over")), step.where(running)
        for _ in range(JUMPS):  # a node that has seen an end looks up nothing, under a key of its own: ends may be popular
            key = F.when(F.col("done"), F.concat(F.lit("\0"), "node")).otherwise(F.col("ptr"))
            moved = moved.withColumn("key", key).join(ahead, "key", "left").select("node", F.coalesce("far", "ptr").alias("ptr"), F.coalesce("over", F.lit(True)).alias("done"))
        before = now
        step, now = cut_counting(moved.unionByName(step.where("done")), running, replaces=step)
    if not now:
        return step.where(running).select("node", F.col("ptr").alias("label"))
    # what is left runs into cycles: rounds go on until the pointers are the cycles themselves
    step, image = cut(step.where(running), replaces=step), -1
    while (now := step.select("ptr").distinct().count()) != image:
        image = now
        ahead, moved = step.select(F.col("node").alias("ptr"), F.col("ptr").alias("far")), step
        for _ in range(JUMPS):
            moved = moved.join(ahead, "ptr").select("node", F.col("far").alias("ptr"), "done")
        step = cut(moved, replaces=step)
    # going around the cycles spreads the smallest id
    on = step.select(F.col("ptr").alias("node")).distinct()
    low = cut(edges.join(on, "node").select("node", F.col("parent").alias("ptr"), F.least("node", "parent").alias("low")), replaces=step)
    seen = 1
    while seen < image:
        ahead, moved = low.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("low2")), low
        for _ in range(JUMPS):
            moved = moved.join(ahead, "ptr").select("node", F.col("far").alias("ptr"), F.least("low", "low2").alias("low"))
        low, seen = cut(moved, replaces=low), seen * (JUMPS + 1)
    return low.select("node", F.col("low").alias("label"))


def _forest(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(node, parent, kind, label): a forest in which cycle nodes and missing parents are roots too."""
    known = edges.select(F.col("node").alias("parent"))
    missing = edges.where("parent is not null").join(known, "parent", "left_anti").select(F.col("parent").alias("node")).distinct()
    inner = edges.join(cycles, "node", "left").select(
        "node",
        F.when(F.col("label").isNull(), F.col("parent")).alias("parent"),
        F.when(F.col("label").isNotNull(), CYCLE).when(F.col("parent").isNull(), TREE).alias("kind"),
        F.coalesce("label", F.when(F.col("parent").isNull(), F.col("node"))).alias("label"),
    )
    outer = missing.select("node", F.lit(None).cast("string").alias("parent"), F.lit(MISSING).alias("kind"), F.col("node").alias("label"))
    return inner.unionByName(outer)


def _tour(forest: DataFrame) -> DataFrame:
    """Euler tour elements (el, next): el = 2*nid enters node nid, el = 2*nid+1 leaves it."""
    up = forest.select(F.col("node").alias("parent"), F.col("nid").alias("pid"))
    kids = forest.where("parent is not null").join(up, "parent").select("nid", "pid", F.pmod(F.xxhash64("nid"), F.lit(SIBLING_PARTS)).alias("part"))
    chain = Window.partitionBy("pid", "part").orderBy("nid")
    kids = kids.withColumn("after", F.lead("nid").over(chain)).withColumn("head", F.row_number().over(chain) == 1)
    heads = kids.where("head").select("pid", "part", F.col("nid").alias("first"), F.lead("nid").over(Window.partitionBy("pid").orderBy("part")).alias("next_head"))
    kids = kids.join(heads, ["pid", "part"]).withColumn("after", F.coalesce("after", "next_head"))
    first = heads.groupBy("pid").agg(F.min_by("first", "part").alias("child"))
    enter = forest.join(first, forest["nid"] == first["pid"], "left").select((F.col("nid") * 2).alias("el"), F.coalesce(F.col("child") * 2, F.col("nid") * 2 + 1).alias("next"))
    leave = kids.select((F.col("nid") * 2 + 1).alias("el"), F.coalesce(F.col("after") * 2, F.col("pid") * 2 + 1).alias("next"))
    last = forest.where("parent is null").select((F.col("nid") * 2 + 1).alias("el"), F.lit(None).cast("bigint").alias("next"))
    return enter.unionByName(leave).unionByName(last)


def _rank(tour: DataFrame) -> DataFrame:
    """List ranking: (el, last, rank, height) with the list's last element, the number of
    elements after ``el`` and the sum of +1 per entry and -1 per exit from ``el`` on."""
    weight = F.when(F.col("el") % 2 == 0, 1).otherwise(-1).cast("bigint")
    running = ~F.col("done")
    first = tour.select("el", F.coalesce("next", "el").alias("ptr"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("rank"), weight.alias("height"), F.col("next").isNull().alias("done"))
    state, left = cut_counting(first, running)
    # a running element holds the sums up to, not with, its pointer; a finished one up to the list's end
    while left:
        ahead = state.select(F.col("el").alias("key"), F.col("ptr").alias("far"), F.col("rank").alias("r2"), F.col("height").alias("h2"), F.col("done").alias("over"))
        moved = state.where(running)
        for _ in range(JUMPS):  # an element that has reached its end looks up nothing
            moved = moved.withColumn("key", F.when(F.col("done"), -1 - F.col("el")).otherwise(F.col("ptr"))).join(ahead, "key", "left")
            sums = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("rank", "r2"), ("height", "h2"))]
            moved = moved.select("el", F.coalesce("far", "ptr").alias("ptr"), *sums, F.coalesce("over", F.lit(True)).alias("done"))
        state, left = cut_counting(moved.unionByName(state.where("done")), running, replaces=state)
    return state.select("el", F.col("ptr").alias("last"), "rank", "height")


def hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row per node: (node, parent, kind, root, depth, enter, leave, tour_root, n_descendants, listed).

    ``kind`` is tree, cycle or missing by where the chain ends; ``root`` is the
    root, the smallest id on the cycle or the missing id; ``depth`` counts the
    links up to the tour's root. Inside one ``tour_root``, a is an ancestor of v
    or v itself exactly if a.enter <= v.enter <= a.leave. ``listed`` is false for
    ids that are only named as a parent.
    """
    edges = cut(links(rows, id_col, parent_col))
    forest = cut(_forest(edges, expose_cycles(edges)).withColumn("nid", F.monotonically_increasing_id()))
    ranked = _rank(_tour(forest)).withColumn("nid", F.shiftright("el", 1))
    spans = ranked.groupBy("nid").agg(
        F.max(F.when(F.col("el") % 2 == 0, -F.col("rank"))).alias("enter"),
        F.max(F.when(F.col("el") % 2 == 1, -F.col("rank"))).alias("leave"),
        F.max(F.when(F.col("el") % 2 == 0, -F.col("height"))).alias("depth"),
        F.shiftright(F.max("last"), 1).alias("tour_root"),
    )
    tops = forest.where("parent is null").select(F.col("nid").alias("tour_root"), F.col("kind").alias("top_kind"), F.col("label").alias("root"))
    return (
        forest.join(spans, "nid")
        .join(tops, "tour_root")
        .select(
            "node",
            "parent",
            F.col("top_kind").alias("kind"),
            "root",
            "depth",
            "enter",
            "leave",
            "tour_root",
            F.shiftright(F.col("leave") - F.col("enter"), 1).alias("n_descendants"),
            (F.coalesce("kind", F.lit(TREE)) != MISSING).alias("listed"),
        )
    )


def roots_and_depths(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(node, root, depth) per distinct id; depth -1 if the chain runs into a cycle, -2 if its end has no row."""
    depth = F.when(F.col("kind") == CYCLE, F.lit(-1)).when(F.col("kind") == MISSING, F.lit(-2)).otherwise(F.col("depth"))
    return hierarchy(rows, id_col, parent_col).where("listed").select("node", "root", depth.cast("bigint").alias("depth"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for all nodes below each node, from the intervals of ``hierarchy``.

    Each interval is cut into aligned blocks of powers of two and each entry is
    looked up by its block at every level: an equality join whose output is
    exactly the result, instead of a range join within a tree.
    """
    # a tour's positions run from 0 down to minus its length; one aggregate row tells how far
    reach = tree.agg(F.coalesce(-F.min("enter"), F.lit(0)).alias("reach")).select(F.expr("cast(floor(log2(reach + 1)) + 1 as int)").alias("height"))
    tree = tree.crossJoin(F.broadcast(reach)).withColumn("shift", F.expr("shiftleft(1L, height)"))
    levels = F.explode(F.sequence(F.lit(0), F.col("height"))).alias("level")
    span = tree.where("leave - enter > 1").select(F.col("node").alias("ancestor"), F.col("depth").alias("depth_a"), "tour_root", (F.col("enter") + 1 + F.col("shift")).alias("lo"), (F.col("leave") + F.col("shift")).alias("hi"), levels)
    unit = F.expr("shiftleft(1L, level)")
    span = span.withColumn("lo", F.ceil(F.col("lo") / unit)).withColumn("hi", F.floor(F.col("hi") / unit)).where("lo < hi")
    left = F.when(F.col("lo") % 2 == 1, F.col("lo"))
    right = F.when((F.col("hi") % 2 == 1) & (F.col("hi") - 1 >= F.col("lo") + F.col("lo") % 2), F.col("hi") - 1)
    blocks = span.select("ancestor", "depth_a", "tour_root", "level", F.explode(F.array_compact(F.array(left, right))).alias("block"))
    points = tree.select(F.col("node").alias("descendant"), F.col("depth").alias("depth_d"), "tour_root", (F.col("enter") + F.col("shift")).alias("at"), levels)
    points = points.select("descendant", "depth_d", "tour_root", "level", F.floor(F.col("at") / F.expr("shiftleft(1L, level)")).alias("block"))
    return points.join(blocks, ["tour_root", "level", "block"]).select("ancestor", "descendant", (F.col("depth_d") - F.col("depth_a")).alias("distance"))


def paths(tree: DataFrame, separator: str = " > ") -> DataFrame:
    """``tree`` with ``path``, the ids from the tour's root down to the node."""
    above = descendants(tree).groupBy("descendant").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "ancestor"))).alias("above"))
    return tree.join(above, tree["node"] == above["descendant"], "left").select(
        *tree.columns, F.concat_ws(separator, F.transform(F.coalesce("above", F.array()), lambda x: x["ancestor"]), "node").alias("path")
    )
