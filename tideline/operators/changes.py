"""Change points of support and the filters on them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut, ship
from tideline.operators.dense import runs
from tideline.operators.postings import SEND_ROWS, small
from tideline.operators.support import BLOCK, positions, probe, steps


def from_intervals(intervals: DataFrame, times: DataFrame, window: int, n: int, level: int = 20) -> DataFrame:
    """Change points of dense intervals.

    ``(pattern, s, e, time, direction, magnitude, before, after)``: up at ``s``,
    down at ``e + 1``, if they are positions of the series. ``before`` and
    ``after`` are means of support over ``level`` positions on either side (0
    if there are none); only those positions are counted. The magnitude is the
    rise or fall, 1 at least.
    """
    top = positions(window, n)
    both = F.array(F.struct(F.col("s").alias("time"), F.lit("up").alias("direction")), F.struct((F.col("e") + 1).alias("time"), F.lit("down").alias("direction")))
    points = intervals.select("pattern", "s", "e", F.explode(both).alias("p")).select("pattern", "s", "e", "p.*").where((F.col("time") >= 0) & (F.col("time") < top))
    return _sized(points, times, window, top, level, "s", "e")


def _sized(points: DataFrame, times: DataFrame, window: int, top: int, level: int, *more: str) -> DataFrame:
    """Change points ``(pattern, time, direction)`` with the means of support on either side, and the magnitude.

    An occurrence counts at as many of the positions on one side as its windows
    begin at. Occurrences and points meet in buckets of ``window`` positions.
    """
    bucket = lambda c: F.floor(c / window)
    time = F.col("time")
    low, high = F.greatest(time - level, F.lit(0)), F.least(time + level, F.lit(top))
    # the places are many fewer than the occurrences, of which only those around them are moved
    asked = cut(points.select("pattern", "time").distinct())
    near = asked.withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(F.greatest(high - 1, low) + window - 1))))
    met = times.select("pattern", "t", bucket(F.col("t")).alias("bucket")).join(small(cut(near), 5 * SEND_ROWS), ["pattern", "bucket"])
    covered = lambda first, last: F.greatest(F.least(last, F.col("t")) - F.greatest(first, F.col("t") - (window - 1)) + 1, F.lit(0))
    sums = met.groupBy("pattern", "time").agg(F.sum(covered(low, time - 1)).alias("__before"), F.sum(covered(time, high - 1)).alias("__after"))
    mean = lambda c, count: F.when(count > 0, F.coalesce(c, F.lit(0)) / F.greatest(count, F.lit(1)).cast("double")).otherwise(F.lit(0.0))
    sized = points.join(sums, ["pattern", "time"], "left").withColumns({"before": mean(F.col("__before"), time - low), "after": mean(F.col("__after"), high - time)})
    change = F.when(F.col("direction") == "up", F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    return sized.select("pattern", *more, "time", "direction", F.greatest(F.lit(1.0), change).alias("magnitude"), "before", "after")


def threshold_crossings(times: DataFrame, patterns: DataFrame, window: int, n: int, theta: int, level: int = 20, block: int = BLOCK) -> DataFrame:
    """Where the support of a pattern rises to ``theta`` or falls below it; the series before its first position counts as below.

    The positions with support ``theta`` or more are runs of left ends, found in
    blocks of the axis; only around their ends is the support looked at.
    """
    top = positions(window, n)
    inside = times.where((F.col("t") >= 0) & (F.col("t") < n))
    if theta < 1:
        above = patterns.select("pattern").distinct().select("pattern", F.lit(0).cast("long").alias("s"), F.lit(top - 1).cast("long").alias("e"))
    else:
        above = runs(inside, window - 1, theta, block=block, least=0).select("pattern", F.greatest("s", F.lit(0)).cast("long").alias("s"), "e").where("e >= 0")
    both = F.array(F.struct(F.col("s").alias("time"), F.lit("up").alias("direction")), F.struct((F.col("e") + 1).alias("time"), F.lit("down").alias("direction")))
    points = above.select("pattern", F.explode(both).alias("p")).select("pattern", "p.*").where(F.col("time") < top)
    return _sized(points, inside, window, top, level)


def alarms(a: int, b: int, gain: float, held: float, bound: float) -> tuple[list[int], list[float], float]:
    """One side of a cumulative sum over positions a .. b, each of which adds ``gain``: alarm times, their sums, and what is held after b.

    The sum never falls below 0 and starts again at 0 after each alarm; it is
    rounded to 9 places where it is compared with the bound.
    """
    if gain <= 0:
        return [], [], max(0.0, held + (b - a + 1) * gain)

    def needed(start: float) -> int:
        """After how many positions the sum passes the bound."""
        k = max(1, int((bound - start) / gain) - 1)
        while round(start + k * gain, 9) <= bound:
            k += 1
        return k

    first, every = needed(held), needed(0.0)
    if a + first - 1 > b:
        return [], [], held + (b - a + 1) * gain
    times = list(range(a + first - 1, b + 1, every))
    return times, [held + first * gain] + [every * gain] * (len(times) - 1), (b - times[-1]) * gain


def cusum(times: DataFrame, patterns: DataFrame, window: int, n: int, drift: float = 0.5, bound: float = 4.0) -> DataFrame:
    """Two-sided cumulative sums of support about its mean that start again after each alarm.

    ``(pattern, time, direction, magnitude, before, after)``: the support at
    the alarm and at the position before it (0 at the first). A pattern's
    stretches pass in order through one task, which holds two sums and no
    series; a stretch of equal support is worked out at once. Series of fewer
    than two positions have no alarms.
    """
    if positions(window, n) < 2:
        return patterns.select("pattern", F.lit(0).cast("long").alias("time"), F.lit("").alias("direction"), *(F.lit(0.0).alias(c) for c in ("magnitude", "before", "after"))).limit(0)
    ship(times.sparkSession)
    found = cut(steps(times, patterns, window, n))
    means = found.groupBy("pattern").agg((F.sum(F.col("support") * (F.col("b") - F.col("a") + 1)) / F.lit(float(positions(window, n)))).alias("mean"))
    kind = patterns.schema["pattern"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, up, down, last = None, 0.0, 0.0, 0.0
        for batch in batches:
            place, columns = [], ([], [], [], [], [])
            for i, (pattern, a, b, support, mean) in enumerate(zip(*(batch[c].to_pylist() for c in ("pattern", "a", "b", "support", "mean")))):
                if pattern != own:
                    own, up, down, last = pattern, 0.0, 0.0, 0.0
                for sign, name in ((1, "up"), (-1, "down")):
                    held = up if sign > 0 else down
                    at, sums, held = alarms(a, b, sign * (support - mean) - drift, held, bound)
                    up, down = (held, down) if sign > 0 else (up, held)
                    place += [i] * len(at)
                    for c, v in zip(columns, (at, [name] * len(at), sums, [last if t == a else float(support) for t in at], [float(support)] * len(at))):
                        c += v
                last = float(support)
            take = pa.array(place, pa.int64())
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch["pattern"].take(take), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["pattern", "time", "direction", "magnitude", "before", "after"])

    ordered = found.join(small(cut(means)), "pattern").select("pattern", "a", "b", "support", "mean").repartition("pattern").sortWithinPartitions("pattern", "a")
    return ordered.mapInArrow(run, f"pattern {kind}, time long, direction string, magnitude double, before double, after double")


def detect(times: DataFrame, patterns: DataFrame, window: int, n: int, method: str = "threshold_crossing", *, theta: int = 5, level: int = 20, drift: float = 0.5, bound: float = 4.0) -> DataFrame:
    """Change points of the support of patterns by a named method."""
    if method == "threshold_crossing":
        return threshold_crossings(times, patterns, window, n, theta, level)
    if method == "cusum":
        return cusum(times, patterns, window, n, drift, bound)
    raise ValueError(f"no method {method}")


def bare(intervals: DataFrame, window: int, n: int, convention: str = "bag") -> DataFrame:
    """``(pattern, time)``. ``bag``: starts and ends that are positions of the series, with repeats; ``set``: all starts, and ends before ``n``, once each."""
    top = positions(window, n)
    both = intervals.select("pattern", F.explode(F.array(F.struct(F.col("s").alias("time"), F.lit(True).alias("first")), F.struct((F.col("e") + 1).alias("time"), F.lit(False).alias("first")))).alias("p")).select("pattern", "p.*")
    if convention == "bag":
        return both.where(F.when(F.col("first"), F.col("time") >= 0).otherwise(F.lit(True)) & (F.col("time") < top)).select("pattern", "time")
    return both.where(F.col("first") | (F.col("time") < n)).select("pattern", "time").distinct()


def support_range(steps: DataFrame, least: int) -> DataFrame:
    """patterns whose support varies by ``least`` or more; takes a series or its steps."""
    return steps.groupBy("pattern").agg((F.max("support") - F.min("support")).alias("range")).where(F.col("range") >= least).select("pattern")


def sampled_range(intervals: DataFrame, times: DataFrame, window: int, n: int, least: int) -> DataFrame:
    """the same from samples: the middles of intervals against both ends of the axis and the middles of the gaps."""
    top = positions(window, n)
    order = Window.partitionBy("pattern").orderBy("s", "e")
    inside = intervals.select("pattern", F.floor((F.col("s") + F.col("e")) / 2).alias("t"), F.lit(True).alias("inside"))
    gaps = intervals.select("pattern", F.floor((F.col("e") + F.lead("s").over(order)) / 2).alias("t"), F.lit(False).alias("inside")).where("t is not null")
    ends = intervals.select("pattern").distinct().select("pattern", F.explode(F.array(F.lit(0).cast("long"), F.lit(top - 1).cast("long"))).alias("t"), F.lit(False).alias("inside"))
    asked = inside.unionByName(gaps).unionByName(ends).where((F.col("t") >= 0) & (F.col("t") < top))
    seen = asked.join(probe(times, asked, window), ["pattern", "t"])
    found = seen.groupBy("pattern").agg(F.coalesce(F.max(F.when(F.col("inside"), F.col("support"))), F.lit(0)).alias("high"), F.coalesce(F.min(F.when(~F.col("inside"), F.col("support"))), F.lit(0)).alias("low"))
    return found.where(F.col("high") - F.col("low") >= least).select("pattern")


def strong(points: DataFrame, magnitude: float = 0.0, relative: float = 0.0) -> DataFrame:
    """F16: change points of at least a magnitude, and at least a share of what was before (1 at least)."""
    return points.where((F.col("magnitude") >= magnitude) & (F.col("magnitude") / F.greatest(F.lit(1.0), F.col("before")) >= relative))
