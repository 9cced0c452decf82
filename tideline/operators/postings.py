"""The index axis, dictionaries, posting lists and their intersections.

Transactions are rows ``(t, baskets array<array<long>>)``; occurrences are rows
``(t, basket_id, item)``; patterns are sorted ``array<long>`` columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut

#: Rows up to which a side of a join is broadcast, after they are counted.
SEND_ROWS = 100_000


def small(frame: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """``frame``, with a hint to broadcast it if it has at most ``most`` rows. Counts it, so give a stored frame."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def ordered_index(frame: DataFrame, *by: str, name: str = "t") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``by``, without ever sorting them in one task.

    The rows are range-partitioned and sorted, then stored; a row's number is
    its place in its partition plus the sizes of the partitions before it.
    """
    order = [F.col(c) for c in by]
    placed = cut(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    offsets = cut(sizes.select("__part", before.alias("__before")))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before")


def dictionary(frame: DataFrame, column: str, name: str = "item") -> DataFrame:
    """``(column, name)``, the rank of each distinct value from 0."""
    return ordered_index(frame.select(column).where(F.col(column).isNotNull()).distinct(), column, name=name)


def occurrences(transactions: DataFrame) -> DataFrame:
    """one row per basket and item, ``(t, basket_id, item)``, each item once per basket (F1).

    ``basket_id`` numbers all baskets, empty ones too, in the order of (t, place). Transactions without baskets only take up their ``t``.
    """
    baskets = transactions.select("t", F.posexplode("baskets").alias("pos", "items"))
    numbered = ordered_index(baskets, "t", "pos", name="basket_id")
    return numbered.select("t", "basket_id", F.explode(F.array_distinct("items")).alias("item"))


def by_transaction(occ: DataFrame) -> DataFrame:
    """``(item, t)``, each item once per transaction."""
    return occ.select("item", "t").distinct()


def flat_postings(transactions: DataFrame) -> DataFrame:
    """``(item, t)`` of flat transactions ``(t, items)``."""
    return transactions.select(F.explode(F.array_distinct("items")).alias("item"), "t")


def normal_form(pattern: Column | str) -> Column:
    """the sorted pattern."""
    return F.array_sort(pattern)


def intersect(postings: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """``(pattern, key)`` for each key whose posting lists hold all items of the pattern.

    ``postings``: ``(item, key, ...)`` without repeats; further columns must depend on the key, and stay.
    A key's items are held as one array. Item by item, the beginnings of patterns that a key
    holds look up what may follow and keep what the array has, so an item in many patterns
    makes no rows for patterns that aren't there.
    """
    kind, given = postings.schema["item"].dataType.simpleString(), patterns.schema["pattern"].dataType.simpleString()
    wanted = cut(patterns.select("pattern", F.array_sort(F.array_distinct("pattern")).cast(f"array<{kind}>").alias("__set")).distinct())
    rest = [c for c in postings.columns if c not in ("item", key)]
    items = cut(wanted.select(F.explode("__set").alias("item")).distinct())
    sizes = [r[0] for r in wanted.select(F.size("__set").alias("n")).distinct().where("n > 0").collect()]
    if not sizes:
        return postings.select(F.lit(None).cast(given).alias("pattern"), key, *rest).limit(0)
    lists = postings.join(small(items), "item", "left_semi").groupBy(key).agg(F.collect_list("item").alias("__items"), *(F.first(c).alias(c) for c in rest))
    if len(sizes) > 1:
        lists = cut(lists)
    held = lists.select(key, *rest, "__items", F.explode("__items").alias("__item")).select(key, *rest, "__items", F.array("__item").alias("__set"))
    found = []
    for size in range(1, max(sizes) + 1):
        if size in sizes:
            found.append(held.join(small(wanted.where(F.size("__set") == size)), "__set").select("pattern", key, *rest))
        if size < max(sizes):
            grows = wanted.where(F.size("__set") > size).select(F.slice("__set", 1, size).alias("__set"), F.col("__set")[size].alias("__next"))
            grows = cut(grows.groupBy("__set").agg(F.collect_set("__next").alias("__next")))
            held = held.join(small(grows), "__set").select(key, *rest, "__items", "__set", F.explode(F.array_intersect("__next", "__items")).alias("__item"))
            held = held.select(key, *rest, "__items", F.concat("__set", F.array("__item")).alias("__set"))
    return reduce(DataFrame.unionByName, found)


def to_transactions(baskets: DataFrame) -> DataFrame:
    """``(pattern, t)``, a row for each basket: a transaction counts as often as it has the pattern."""
    return baskets.select("pattern", "t")


def timestamps(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """M6: ``(pattern, t)``, the transactions that have all items of a pattern, in whichever baskets."""
    return intersect(by_transaction(occ), patterns, "t")
