"""Dense intervals.

A left end ``l`` is dense if at least ``theta`` occurrences lie in
``[l, l + window]``. The dense left ends are the union over occurrences i of
``[t[i + theta - 1] - window, t[i]]``, where that is not empty: gaps and
islands, found with one look-ahead per occurrence.

A pattern's occurrences are cut into blocks of the axis, each with the next
``window`` positions of the block after it, so no task holds all occurrences of
a frequent pattern; blocks leave merged runs, and only those meet per pattern.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import ship
from tideline.operators.intervals import merge, overlap

#: Least width of a block of the axis.
BLOCK = 1 << 16


def check(window: int, theta: int, least: int = 1) -> None:
    if window < least or theta < 1:
        raise ValueError("window and theta must be at least 1")


def runs(times: DataFrame, window: int, theta: int, *keys: str, convention: str = "left_endpoint", block: int = BLOCK, least: int = 1) -> DataFrame:
    """``(keys..., s, e)``, the maximal dense intervals of each key's bag of times ``t``.

    ``left_endpoint``: the run of dense left ends; ``s`` may be negative.
    ``span``: from the first occurrence of the run to the last one that its
    windows hold, kept if it is at least ``window`` wide. ``least``: the
    narrowest window that is allowed; one of 0 holds a single position.
    """
    check(window, theta, least)
    if convention not in ("left_endpoint", "span"):
        raise ValueError(f"no convention {convention}")
    keys = keys or ("pattern",)
    wide = max(block, 8 * window)
    own = F.floor(F.col("t") / wide)
    blocks = F.when((F.floor((F.col("t") - window) / wide) < own), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = times.select(*keys, "t", own.alias("__own"), F.explode(blocks).alias("__block"))
    order = Window.partitionBy(*keys, "__block").orderBy("t")
    ahead = F.lead("t", theta - 1).over(order)
    found = dealt.withColumn("__ahead", ahead)
    extra, columns = {}, []
    if convention == "span":
        found = found.withColumn("__last", F.max("t").over(order.rangeBetween(Window.currentRow, window)))
        extra, columns = {"first": F.min("first"), "last": F.max("last")}, [F.col("t").alias("first"), F.col("__last").alias("last")]
    found = found.where((F.col("__own") == F.col("__block")) & (F.col("__ahead") - F.col("t") <= window))
    segments = found.select(*keys, "__block", (F.col("__ahead") - window).alias("s"), F.col("t").alias("e"), *columns)
    joined = merge(merge(segments, *keys, "__block", extra=extra).drop("__block"), *keys, extra=extra)
    if convention == "left_endpoint":
        return joined
    return joined.select(*keys, F.col("first").alias("s"), F.col("last").alias("e")).where(F.col("e") - F.col("s") >= window)


def runs_within(times: DataFrame, window: int, theta: int, allowed: DataFrame, *keys: str, convention: str = "left_endpoint") -> DataFrame:
    """Dense intervals inside allowed ranges ``(keys..., s, e)``.

    The runs are cut to the ranges. Where every transaction is one basket, a
    pattern is dense only where its items are, so the cut changes nothing and
    the result is that of a scan over the ranges.
    """
    keys = keys or ("pattern",)
    found = runs(times, window, theta, *keys, convention=convention)
    if convention == "span":
        met = found.join(allowed.withColumnsRenamed({"s": "__s", "e": "__e"}), list(keys)).where((F.col("s") <= F.col("__e")) & (F.col("__s") <= F.col("e")))
        return met.drop("__s", "__e").distinct()
    return overlap(found, allowed, *keys).distinct()


def _look(ts: list[int], at: int, window: int, theta: int) -> tuple[int | None, int, int | None]:
    """What the window at ``at`` shows: the earliest left end that is dense with it (None if it is not), its last occurrence, and where to look next."""
    i, j = bisect_left(ts, at), bisect_right(ts, at + window)
    if j - i < theta:
        k = bisect_right(ts, at)
        return None, at, ts[k] if k < len(ts) else None
    turn = ts[j - theta]  # up to here the window stays dense whatever comes after it
    return ts[i + theta - 1] - window, ts[j - 1], turn if turn > at and j - i > theta else at + 1


def scan(ts: list[int], window: int, theta: int, ranges: list[tuple[int, int]], convention: str = "left_endpoint") -> list[tuple[int, int]]:
    """D2 as a scan in order, for results that depend on where it looks.

    It matters where occurrences are counted per basket, and for spans: what was
    found once is not entered again, so a run that begins inside the span of
    one before starts after it.
    """
    check(window, theta)
    found: list[tuple[int, int]] = []
    known: list[list[int]] = []  # found intervals, joined where they touch

    def close(run: list[int] | None) -> None:
        if run is None or any(a <= run[0] and run[1] <= b for a, b in known):
            return
        found.append((run[0], run[1]))
        touching = [x for x in known if x[0] <= run[1] + 1 and run[0] <= x[1] + 1]
        known[:] = sorted([x for x in known if x not in touching] + [[min([run[0]] + [x[0] for x in touching]), max([run[1]] + [x[1] for x in touching])]])

    for low, high in sorted(ranges) if ts else ():
        at: int | None = low
        run: list[int] | None = None
        while at is not None and at <= min(high, ts[-1]):
            past = next((b for a, b in known if a <= at <= b), None)
            if past is not None:
                at = past + 1
                continue
            begin, last, onward = _look(ts, at, window, theta)
            if begin is None:
                close(run)
                run = None
            elif run is None:
                run = [at, last] if convention == "span" else [begin, at]
            else:
                run[1] = max(run[1], last if convention == "span" else at)
            at = onward
        close(run)
    return found


def scanned_within(times: DataFrame, window: int, theta: int, allowed: DataFrame, convention: str = "left_endpoint") -> DataFrame:
    """D2 by :func:`scan`, pattern by pattern; a pattern's occurrences and ranges must fit into one task."""
    ship(times.sparkSession)
    check(window, theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, (ts, ranges) in enumerate(zip(batch["ts"].to_pylist(), batch["ranges"].to_pylist())) for x in scan(ts, window, theta, [(r["s"], r["e"]) for r in ranges], convention)]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["pattern"].take(columns[0]), *columns[1:]], ["pattern", "s", "e"])

    kind = times.schema["pattern"].dataType.simpleString()
    own = times.groupBy("pattern").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ranges = allowed.groupBy("pattern").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    return own.join(ranges, "pattern").mapInArrow(run, f"pattern {kind}, s long, e long")
