"""Level-wise mining of dense itemsets (M1-M5, M7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut, store
from tideline.operators.dense import check, runs, runs_within, scanned_within
from tideline.operators.intervals import at_least, overlap
from tideline.operators.postings import SEND_ROWS, by_transaction, small


def candidates(level: DataFrame) -> DataFrame:
    """M1: patterns one longer than those of ``level``, from two that differ in the last item only."""
    head = F.slice("pattern", 1, F.size("pattern") - 1)
    a = level.select(head.alias("head"), F.element_at("pattern", -1).alias("x"))
    b = a.withColumnRenamed("x", "y")
    return a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("pattern"))


def prune(made: DataFrame, level: DataFrame) -> DataFrame:
    """M2: candidates all of whose subsets with one item less are in ``level``."""
    less = F.transform(F.sequence(F.lit(0), F.size("pattern") - 1), lambda i: F.filter("pattern", lambda _, j: j != i))
    parts = made.select("pattern", F.explode(less).alias("part"))
    met = parts.join(level.select(F.col("pattern").alias("part")), "part", "left_semi")
    return met.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") == F.size("pattern")).select("pattern")


def singles(occ: DataFrame, window: int, theta: int, convention: str = "left_endpoint") -> DataFrame:
    """M3: dense intervals of single items."""
    times = by_transaction(occ).select(F.array("item").alias("pattern"), "t")
    return runs(times, window, theta, convention=convention)


def dense_itemsets(occ: DataFrame, window: int, theta: int, max_length: int = 100, convention: str = "left_endpoint", scanned: bool = False) -> DataFrame:
    """M4: ``(pattern, size, s, e)`` of all dense itemsets, single items included.

    ``occ``: ``(t, basket_id, item)``, each item once per basket. Items that are
    never dense are dropped first. Every level looks up which items may follow
    the patterns of the level before, keeps those that their baskets hold, and
    finds dense intervals inside the common ranges of their items. The
    driver only asks whether a level is empty; each level is stored. With
    ``scanned``, intervals are those of a scan in order (:func:`dense.scan`)
    instead of runs cut to the ranges.
    """
    check(window, theta)
    first = cut(singles(occ, window, theta, convention))
    within = scanned_within if scanned else runs_within
    shown = first
    if scanned:
        times = by_transaction(occ).select(F.array("item").alias("pattern"), "t")
        shown = cut(within(times, window, theta, times.groupBy("pattern").agg(F.min("t").alias("s"), F.max("t").alias("e")), convention=convention))
    found = [shown.select("pattern", F.lit(1).alias("size"), "s", "e")]
    level = shown.select("pattern").distinct()
    items = level.select(F.col("pattern")[0].alias("item"))
    base = store(occ.join(small(items), "item", "left_semi").select("basket_id", "t", "item"))
    # the items of a basket as one array: a basket of k items never makes k * k rows, only those that a candidate asks for
    baskets = store(base.groupBy("basket_id").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1))
    held = base.select("basket_id", "t", F.array("item").alias("pattern"))
    ranges, dense = first, shown
    single_ranges = first.select(F.col("pattern")[0].alias("__item"), "s", "e")
    size = 2
    while size <= max_length and not dense.isEmpty():
        made = prune(candidates(level), level) if size > 2 else candidates(level)
        # common ranges of all items: those of the head and those of the last item
        parts = made.select("pattern", F.slice("pattern", 1, size - 1).alias("head"), F.element_at("pattern", -1).alias("__item"))
        from_head = parts.join(ranges.withColumnRenamed("pattern", "head"), "head").select("pattern", "__item", "s", "e")
        ranges = cut(overlap(from_head, single_ranges, "__item").select("pattern", "s", "e").distinct())
        allowed = at_least(ranges, window)
        wanted = allowed.select(F.slice("pattern", 1, size - 1).alias("pattern"), F.element_at("pattern", -1).alias("next")).groupBy("pattern").agg(F.collect_set("next").alias("next"))
        wanted = cut(wanted)
        total = wanted.agg(F.sum(F.size("next"))).first()[0] or 0
        grown = held.join(F.broadcast(wanted) if total <= 5 * SEND_ROWS else wanted, "pattern").join(baskets, "basket_id").select("basket_id", "t", "pattern", F.explode(F.array_intersect("next", "items")).alias("item"))
        held = store(grown.select("basket_id", "t", F.concat("pattern", F.array("item")).alias("pattern")))
        dense = cut(within(held.select("pattern", "t"), window, theta, allowed, convention=convention))
        level = dense.select("pattern").distinct()
        if size < max_length:
            held = held.join(small(level), "pattern", "left_semi")
        found.append(dense.select("pattern", F.lit(size).alias("size"), "s", "e"))
        size += 1
    return reduce(DataFrame.unionByName, found)


def pair_counts(occ: DataFrame) -> DataFrame:
    """M7: ``(a, b, n)``: in how many baskets two items are together."""
    b = occ.select("basket_id", F.col("item").alias("b"))
    return occ.select("basket_id", F.col("item").alias("a")).join(b, "basket_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def mid_frequency_pairs(occ: DataFrame, pairs: int, top: int = 200, low: int = 50, high: int = 150) -> list[tuple[int, int]]:
    """M7: pairs of items of middling frequency that are seldom together; no item is used twice.

    At most ``top`` items and their pairs reach the driver.
    """
    counts = occ.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top)
    ranked = [r.item for r in counts.collect()]
    middle = ranked[low:high]
    if len(middle) < 2 * pairs:
        middle = ranked[5:] if len(ranked) > 10 else ranked
    chosen = occ.where(F.col("item").isin(middle))
    together = {(r.a, r.b): r.n for r in pair_counts(chosen).collect()}
    out, left = [], list(middle)
    while len(out) < pairs and len(left) > 1:
        a = left.pop(0)
        b = min(left, key=lambda x: together.get((min(a, x), max(a, x)), 0))
        left.remove(b)
        out.append((min(a, b), max(a, b)))
    return out
