"""Budgeted selection and assembly of context.

Costs are whole numbers of at least 1, which bounds what a budget can take of a group, however large
the group is: the first ``budget`` rows, or, where an overflow is skipped, of every cost c the first
budget/c rows, since the room never grows. Groups are cut to that before anything is folded, in salted
parts first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group in which its first rows are looked for side by side.
PARTS = 32


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: Column) -> DataFrame:
    """At most ``most`` first rows of each group, by parts and then of what they leave; equal rows by id."""
    near = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    for by in ([*keys, "_part"], keys):
        near = near.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "id"))).where(F.col("_nth") <= most)
    return near.drop("_part", "_nth")


def prefix_within(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows (id, ...) of each group, in order, until the budget would overflow."""
    near = first_of_each(rows, keys, order, F.lit(budget))
    spent = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order, "id").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("spent", spent).where(F.col("spent") <= budget)


def breadth_within(rows: DataFrame, key: str, unit: str, cost: str, rank: str, budget: int) -> DataFrame:
    """(key, id): first the best fragment of every unit by rank, skipping what overflows, then the rest by rank.

    Only fragments that the budget can reach are folded, at most budget times its harmonic number per group and turn.
    """
    rows = rows.select(key, "id", unit, cost, rank).where(F.col(cost) <= budget)
    best = rows.groupBy(key, unit).agg(F.min(F.struct(rank, "id", cost)).alias("b")).select(key, "b.id", F.col(f"b.{cost}").alias(cost), F.col(f"b.{rank}").alias(rank), F.lit(0).alias("turn"))
    rest = rows.join(best.select("id"), "id", "left_anti").select(key, "id", cost, rank, F.lit(1).alias("turn"))
    near = first_of_each(best.unionByName(rest), [key, "turn", cost], [F.col(rank)], F.floor(F.lit(budget) / F.col(cost)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, taken = budget, []
        for name, need in group.sort_values(["turn", rank, "id"])[["id", cost]].itertuples(index=False):
            if need <= left:
                left -= need
                taken.append(name)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(taken), "id": taken})

    kind = dict(rows.dtypes)[key]
    return near.groupBy(key).applyInPandas(run, f"{key} {kind}, id string")


def folded(rows: DataFrame, text: str, order: str, least: int = 240) -> DataFrame:
    """``rows`` with ``same_as``: the id of the earliest row with the same long text, null for the earliest itself."""
    digest = F.when(F.length(text) >= least, F.md5(text))
    first = rows.select(digest.alias("digest"), order, "id").where("digest is not null").groupBy("digest").agg(F.min_by("id", order).alias("earliest"))
    out = rows.withColumn("digest", digest).join(first, "digest", "left")
    return out.select(*rows.columns, F.when(F.col("earliest") != F.col("id"), F.col("earliest")).alias("same_as"))
