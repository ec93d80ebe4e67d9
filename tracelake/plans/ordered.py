"""Ordered operations on keys that may hold a large part of all rows.

A window over a key sorts all of its rows in one task. Here keys are cut into
ranges of the order column, each range is a window of its own, and what a row
needs from other ranges comes from one summary row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans.cut import cut

#: Width of a range of the order column; with unique positions, also the most rows of one sort.
WIDTH = 50_000


def _ranged(rows: DataFrame, keys: list[str], order: str, width: int) -> tuple[DataFrame, list[str]]:
    return rows.withColumn("_range", F.floor(F.col(order) / width)), [*keys, "_range"]


def with_previous(rows: DataFrame, keys: list[str], order: str, column: str, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``name``: the value of ``column`` in the row before, by ``order``, of the same key (null keys are a key)."""
    cut, by = _ranged(rows, keys, order, width)
    ends = cut.groupBy(*by).agg(F.max_by(F.struct(column), order).alias("_end"))
    carry = ends.select(*by, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    place = Window.partitionBy(*by).orderBy(order)
    inside = cut.withColumn("_first", F.row_number().over(place) == 1).withColumn("_inside", F.lag(column).over(place))
    joined = inside.alias("l").join(carry.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    return joined.select("l.*", "r._carry").withColumn(name, F.when(F.col("_first"), F.col("_carry")[column]).otherwise(F.col("_inside"))).select(*rows.columns, name)


def with_running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the key's rows up to and with this one."""
    cut, by = _ranged(rows.withColumn("_value", value), keys, order, width)
    sums = cut.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = sums.select(*by, before.alias("_carry"))
    inside = cut.withColumn("_inside", F.sum("_value").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = inside.alias("l").join(carry.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    return joined.select("l.*", "r._carry").withColumn(name, F.col("_carry") + F.coalesce("_inside", F.lit(0))).select(*rows.columns, name)


def with_running_min(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``name``: the least of ``value`` over the key's rows up to and with this one."""
    cut, by = _ranged(rows.withColumn("_value", value), keys, order, width)
    lows = cut.groupBy(*by).agg(F.min("_value").alias("_low"))
    carry = lows.select(*by, F.min("_low").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = cut.withColumn("_inside", F.min("_value").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = inside.alias("l").join(carry.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    return joined.select("l.*", "r._carry").withColumn(name, F.least("_inside", "_carry")).select(*rows.columns, name)


def with_next_where(rows: DataFrame, keys: list[str], order: str, condition: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``name``: the order value of the next row of the key, after this one, that fulfils ``condition``."""
    cut, by = _ranged(rows.withColumn("_at", F.when(condition, F.col(order))), keys, order, width)
    firsts = cut.groupBy(*by).agg(F.min("_at").alias("_low"))
    carry = firsts.select(*by, F.min("_low").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)).alias("_carry"))
    inside = cut.withColumn("_inside", F.min("_at").over(Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)))
    joined = inside.alias("l").join(carry.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    return joined.select("l.*", "r._carry").withColumn(name, F.coalesce("_inside", "_carry")).select(*rows.columns, name)


def last_of_each(rows: DataFrame, keys: list[str], order: str, n: int, width: int = WIDTH) -> DataFrame:
    """The last ``n`` rows of each key with ``back``, 1 for the last: the last of each range first, then of those."""
    cut, by = _ranged(rows, keys, order, width)
    near = cut.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_back") <= n)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return near.withColumn("back", back).where(F.col("back") <= n).select(*rows.columns, "back")


def with_following(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of ``column`` that comes next in the order of all rows, null for the last and for nulls.

    Rows are cut into ranges of ``column`` of about equal size, so no value's beginning makes a range
    hot; the last row of a range looks at the first of the range behind it.
    """
    parts = cut(rows.where(F.col(column).isNotNull()).repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    firsts = parts.groupBy("_part").agg(F.min(column).alias("_first"))
    # one row per range reaches this window
    carry = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_carry"))
    inside = parts.withColumn("_next", F.lead(column).over(Window.partitionBy("_part").orderBy(column)))
    ordered = inside.join(carry, "_part").select(*rows.columns, F.coalesce("_next", "_carry").alias(name))
    return ordered.unionByName(rows.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast(dict(rows.dtypes)[column])))
