"""De-duplication of results by shared items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.operators.graph import connected_components

#: Items of the longest patterns whose subsets are set out (4,095 at most).
LONGEST = 12


def _best(rows: DataFrame, edges: DataFrame, better: list[Column]) -> DataFrame:
    """The best row of each component; rows without an edge stay."""
    named = connected_components(edges)
    joined = rows.join(named, rows["__id"] == named["node"], "left").withColumn("__c", F.coalesce("component", "__id")).drop("node", "component")
    return joined.withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy(*better))).where("__r = 1").drop("__r", "__c")


def _subsets(pattern: Column, sizes: Column) -> Column:
    """The subsets of a sorted pattern whose size is among ``sizes``, each as a sorted array."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(pattern)).cast("int") - 1)
    chosen = F.filter(masks, lambda m: F.array_contains(sizes, F.bit_count(m)))
    return F.transform(chosen, lambda m: F.filter(pattern, lambda _, j: F.getbit(m, j) == 1))


def _stars(rows: DataFrame, same: list[str], least: Callable[[Column, Column], Column], own: Callable[[Column], Column], sizes: Callable[[Column], Column]) -> DataFrame:
    """Edges with the same components as all links between patterns that share enough items, within equal ``same``.

    ``own(size)``: the items that a pattern must share with one of its size or
    more; ``sizes(size)``: the numbers of items that smaller ones may ask of it;
    ``least(size, size)``: the same as a test of two patterns. Two patterns
    are linked if a subset of the smaller one of its ``own`` size is in both, so
    all patterns with a subset are linked to the first one that asks for it:
    the rows grow with the patterns, however many share an item. Patterns of
    more than ``LONGEST`` items, whose subsets are too many, are compared
    one by one with those that they share an item with.
    """
    size = F.size("pattern")
    usual = rows.where(size <= LONGEST).select(*same, "__id", F.explode(_subsets(F.array_sort(F.array_distinct("pattern")), sizes(size))).alias("subset"), own(size).alias("own"))
    usual = usual.withColumn("asks", F.size("subset") == F.col("own"))
    hubs = usual.where("asks").groupBy(*same, "subset").agg(F.min("__id").alias("hub"))
    edges = usual.join(hubs, [*same, "subset"]).where("__id <> hub").select(F.col("hub").alias("a"), F.col("__id").alias("b")).distinct()
    longer = rows.where(size > LONGEST)
    if longer.isEmpty():
        return edges
    items = rows.select(*same, F.col("__id").alias("b"), F.col("pattern").alias("pb"), F.explode("pattern").alias("item"))
    own_items = longer.select(*same, F.col("__id").alias("a"), F.col("pattern").alias("pa"), F.explode("pattern").alias("item"))
    met = own_items.join(items, [*same, "item"]).where("a <> b").select("a", "b", "pa", "pb").distinct()
    linked = shared(F.col("pa"), F.col("pb")) >= least(F.size("pa"), F.size("pb"))
    return edges.unionByName(met.where(linked).select("a", "b"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return cut(rows.withColumn("__id", F.concat_ws("|", *(F.col(k).cast("string") for k in keys))))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def by_overlap(rows: DataFrame, better: list[Column], keys: list[str] | None = None) -> DataFrame:
    """G1: per event and length, patterns that share at least half their items are one; the best stays.

    ``rows`` has ``pattern`` and ``event_name``; ``keys`` make a row unique.
    """
    rows = _numbered(rows.withColumn("__size", F.size("pattern")), keys or ["pattern", "event_name"])
    half = lambda n: F.ceil(n / 2).cast("int")
    edges = _stars(rows, ["event_name", "__size"], lambda a, b: half(a), half, lambda n: F.array(half(n)))
    return _best(rows, edges, better).drop("__id", "__size")


def by_subset(rows: DataFrame, better: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Per event, a pattern and another that holds it are one; the best stays."""
    rows = _numbered(rows, keys or ["pattern", "event_name"])
    edges = _stars(rows, ["event_name"], F.least, lambda n: n, lambda n: F.sequence(F.lit(1), n))
    return _best(rows, edges, better).drop("__id")


def by_score(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """G1 and G2 by highest ``score``, then longer pattern, then pattern order."""
    better = [F.desc("score"), F.desc(F.size("pattern")), F.col("pattern")]
    return by_subset(by_overlap(rows, better, keys), better, keys)


def by_p(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same by lowest ``adjusted``."""
    better = [F.col("adjusted"), F.desc(F.size("pattern")), F.col("pattern")]
    return by_subset(by_overlap(rows, better, keys), better, keys)


def by_effect(rows: DataFrame, effect: str = "effect") -> DataFrame:
    """One round over patterns of any length that share at least half of the shorter one."""
    rows = _numbered(rows, ["pattern", "event_name"])
    half = lambda n: F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    edges = _stars(rows, ["event_name"], lambda a, b: half(F.least(a, b)), half, lambda n: F.sequence(F.lit(1), half(n)))
    return _best(rows, edges, [F.desc(effect), F.desc(F.size("pattern")), F.col("pattern")]).drop("__id")


def best_per_pair(rows: DataFrame) -> DataFrame:
    """Of each pattern and event the row of highest ``score``, the earliest on a tie."""
    order = Window.partitionBy("pattern", "event_name").orderBy(F.desc("score"), "time")
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
