"""Algebra of inclusive integer intervals in rows ``(key..., s, e)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(intervals: DataFrame, *keys: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """unions of intervals that overlap or touch (``s <= e + 1``), per key; ``extra`` aggregates further columns."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0)
    island = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = intervals.withColumn("__opens", opens).withColumn("__island", island)
    return marked.groupBy(*keys, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"), *(c.alias(n) for n, c in (extra or {}).items())).drop("__island")


def insert(intervals: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """the union of two sets of intervals, per key."""
    return merge(intervals.select(*keys, "s", "e").unionByName(new.select(*keys, "s", "e")), *keys)


def overlap(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """the common parts of the intervals of two lists, per key; ``right`` has ``s`` and ``e`` too."""
    other = right.withColumnsRenamed({"s": "__s", "e": "__e"})
    joined = left.join(other, list(keys)) if keys else left.join(other, F.col("s") <= F.col("__e"))
    both = joined.where((F.col("s") <= F.col("__e")) & (F.col("__s") <= F.col("e")))
    return both.withColumns({"s": F.greatest("s", "__s"), "e": F.least("e", "__e")}).drop("__s", "__e")


def at_least(intervals: DataFrame, width: int) -> DataFrame:
    """F8: intervals with ``e - s >= width``."""
    return intervals.where(F.col("e") - F.col("s") >= width)


def covering(points: DataFrame, intervals: DataFrame, *keys: str, point: str = "p") -> DataFrame:
    """the first interval that holds each point, ``s`` and ``e`` null if none does."""
    named = intervals.select(*(F.col(k).alias(f"__{k}") for k in keys), "s", "e")
    same = (F.col("s") <= F.col(point)) & (F.col(point) <= F.col("e"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    found = points.join(named, same, "left").groupBy(*keys, point).agg(F.min(F.struct("s", "e")).alias("x"))
    return found.select(*keys, point, "x.s", "x.e")


def is_covered(asked: DataFrame, intervals: DataFrame, *keys: str) -> DataFrame:
    """``covered``, whether some interval holds all of [s, e]."""
    named = intervals.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("s").alias("__s"), F.col("e").alias("__e"))
    same = (F.col("__s") <= F.col("s")) & (F.col("e") <= F.col("__e"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    found = asked.join(named, same, "left").groupBy(*keys, "s", "e").agg(F.count("__s").alias("n"))
    return found.select(*keys, "s", "e", (F.col("n") > 0).alias("covered"))


def first_at_least(values: Column, bound: Column) -> Column:
    """the place (from 0) of the first value of a sorted array that is at least ``bound``; its size if none is."""
    return F.size(F.filter(values, lambda x: x < bound))


def first_above(values: Column, bound: Column) -> Column:
    """the place (from 0) of the first value of a sorted array above ``bound``."""
    return F.size(F.filter(values, lambda x: x <= bound))


def length_sums(intervals: DataFrame, *keys: str) -> DataFrame:
    """The number of integers in disjoint intervals, per key."""
    return intervals.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s") + 1).alias("n"))
