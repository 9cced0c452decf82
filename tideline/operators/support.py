"""Support series: how many occurrences lie in ``[t, t + window - 1]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least width of a block of the axis.
BLOCK = 1 << 16


def positions(window: int, n: int) -> int:
    """The number of left ends, ``max(0, n - window + 1)``."""
    return max(0, n - window + 1)


def steps(times: DataFrame, patterns: DataFrame, window: int, n: int, *, block: int = BLOCK, margin: int | None = None) -> DataFrame:
    """``(pattern, a, b, support)``: the series as stretches [a, b] of equal support over 0 .. n - window.

    Each occurrence adds one from ``t - window + 1`` and takes it away after
    ``t``. The axis is cut into blocks of ``block`` positions (or eight windows),
    and so are the stretches: an occurrence matters to two blocks at most, and no
    task holds a whole pattern. The rows grow with the occurrences and the
    number of blocks, not with the length of the axis.

    With ``margin``, every block also shows that many positions on either side
    of it, and its number is in ``block``.
    """
    top = positions(window, n)
    more = ["block"] if margin is not None else []
    if top == 0:
        return patterns.select("pattern", *(F.lit(0).cast("long").alias(c) for c in (*more, "a", "b", "support"))).limit(0)
    side = margin or 0
    wide = max(block, 8 * window, 4 * side)
    last = (top - 1) // wide
    low, high = F.greatest(F.col("block") * wide - side, F.lit(0)), F.least((F.col("block") + 1) * wide + side, F.lit(top))
    first = F.greatest(F.floor((F.col("t") - (window - 1) - side) / wide), F.lit(0))
    dealt = times.where((F.col("t") >= 0) & (F.col("t") < n)).select("pattern", "t", F.explode(F.sequence(first, F.greatest(first, F.least(F.floor((F.col("t") + side) / wide), F.lit(last))))).alias("block"))
    up = dealt.select("pattern", "block", F.greatest(F.col("t") - (window - 1), low).cast("long").alias("at"), F.lit(1).alias("d"), high.alias("high"), low.alias("low"), "t")
    up = up.where("at < high and t >= low").select("pattern", "block", "at", "d")
    down = dealt.select("pattern", "block", (F.col("t") + 1).cast("long").alias("at"), F.lit(-1).alias("d"), high.alias("high"), low.alias("low")).where("at < high and at > low").select("pattern", "block", "at", "d")
    ends = patterns.select("pattern").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).select("pattern", "block", low.cast("long").alias("at"), F.lit(0).alias("d"))
    deltas = up.unionByName(down).unionByName(ends).groupBy("pattern", "block", "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("pattern", "block").orderBy("at")
    level = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.coalesce(F.lead("at").over(order) - 1, high - 1)
    return deltas.select("pattern", *more, F.col("at").alias("a"), ahead.cast("long").alias("b"), level.cast("long").alias("support"))


def series(times: DataFrame, patterns: DataFrame, window: int, n: int) -> DataFrame:
    """``(pattern, t, support)`` for each left end, zeros included. For reports; tests work on :func:`steps`."""
    return steps(times, patterns, window, n).select("pattern", F.explode(F.sequence("a", "b")).alias("t"), "support")


def probe(times: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """S3: ``(pattern, t, support)`` at the asked positions ``(pattern, t)``.

    Occurrences and questions meet in buckets of ``window`` positions: a window
    touches two at most, so the join has an equality in it.
    """
    bucket = lambda c: F.floor(c / window)
    asked = asked.select("pattern", "t").distinct()
    put = asked.select("pattern", F.col("t").alias("q"), F.explode(F.array_distinct(F.array(bucket(F.col("t")), bucket(F.col("t") + window - 1)))).alias("bucket"))
    own = times.groupBy("pattern", "t").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("t")))
    met = put.join(own, ["pattern", "bucket"]).where((F.col("q") <= F.col("t")) & (F.col("t") < F.col("q") + window))
    counted = met.groupBy("pattern", F.col("q").alias("t")).agg(F.sum("n").alias("support"))
    return asked.join(counted, ["pattern", "t"], "left").select("pattern", "t", F.coalesce("support", F.lit(0)).cast("long").alias("support"))
