"""Seven common tests of whether an event goes with a pattern.

They work on the stretches of equal support from :func:`support.steps`, never on
the series position by position: counts, sums and sums of squares over a part
of a stretch have closed forms, and times are counted from the event's start to
keep them small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import upper_tail
from tideline.operators.attribution import bounded
from tideline.operators.changes import bare
from tideline.operators.correction import benjamini_hochberg, significant
from tideline.operators.dedup import by_p

METHODS = ("mann_whitney", "causal_impact", "interrupted", "event_study", "coincidence", "contrast")
TINY = 1e-12


def _cut(low: Column, high: Column) -> tuple[Column, Column]:
    return F.greatest(F.col("a"), low), F.least(F.col("b"), high)


def _parts(steps: DataFrame, events: DataFrame, window: int) -> DataFrame:
    """Each stretch cut at the event: rows with ``part`` (pre, during, post) and [lo, hi] counted from the event's start."""
    crossed = steps.join(bounded(events), F.lit(True))
    first, last = F.col("start") - window + 1, F.col("end")  # positions whose window meets the event
    pieces = []
    for name, low, high in (("pre", F.lit(-(1 << 62)), first - 1), ("during", first, last), ("post", last + 1, F.lit(1 << 62))):
        lo, hi = _cut(low, high)
        pieces.append(F.struct(F.lit(name).alias("part"), (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi")))
    rows = crossed.select("pattern", "event_id", "name", "start", "end", "support", F.explode(F.array(*pieces)).alias("x")).select("*", "x.*").drop("x")
    return rows.where("lo <= hi").withColumn("n", F.col("hi") - F.col("lo") + 1)


KEYS = ["pattern", "event_id", "name", "start", "end"]


def _moments(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """For each named condition: n, sums of t, y, tt, ty, yy as ``<name>_n`` and so on."""
    n, lo, hi, y = (F.col(c).cast("double") for c in ("n", "lo", "hi", "support"))
    t = n * (lo + hi) / 2
    upto = lambda k: k * (k + 1) * (2 * k + 1) / 6
    tt = upto(hi) - upto(lo - 1)
    values = {"n": n, "t": t, "y": n * y, "tt": tt, "ty": t * y, "yy": n * y * y}
    zero = F.lit(0.0)
    return rows.groupBy(*KEYS).agg(*(F.coalesce(F.sum(F.when(test, v)), zero).alias(f"{name}_{k}") for name, test in parts.items() for k, v in values.items()))


def _line(name: str) -> dict[str, Column]:
    """Centred sums and the least-squares line of one group of moments."""
    c = lambda k: F.col(f"{name}_{k}")
    n = F.greatest(c("n"), F.lit(1.0))
    sxx, sxy, syy = c("tt") - c("t") * c("t") / n, c("ty") - c("t") * c("y") / n, c("yy") - c("y") * c("y") / n
    slope = F.when(sxx > TINY, sxy / sxx).otherwise(F.lit(0.0))
    return {"n": c("n"), "mean_t": c("t") / n, "mean_y": c("y") / n, "sxx": sxx, "slope": slope, "level": c("y") / n - slope * c("t") / n, "ssr": F.greatest(syy - slope * sxy, F.lit(0.0))}


def _done(rows: DataFrame, effect: Column, z: Column) -> DataFrame:
    return rows.withColumns({"effect": effect, "z": z}).where(F.col("z").isNotNull()).select(*KEYS, "effect", upper_tail(F.col("z")).alias("p_value"))


def mann_whitney(steps: DataFrame, events: DataFrame, window: int, least: int = 5) -> DataFrame:
    """B1, B2: is support higher in windows that meet the event? Ranks of equal values are averaged.

    Works on counts of distinct values. Fewer than ``least`` positions on either
    side, or no variance, is no test.
    """
    inside = F.col("part") == "during"
    counts = _parts(steps, events, window).groupBy(*KEYS, "support").agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("double").alias("x"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("double").alias("y"))
    order = Window.partitionBy(*KEYS).orderBy("support").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.col("x") + F.col("y")
    ranked = counts.withColumn("rank", F.sum(both).over(order) - both + (both + 1) / 2)
    sums = ranked.groupBy(*KEYS).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.sum(F.col("x") * F.col("rank")).alias("r"), F.sum(both * both * both - both).alias("ties"))
    nx, ny = F.col("nx"), F.col("ny")
    n = nx + ny
    u = F.col("r") - nx * (nx + 1) / 2
    variance = nx * ny / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    enough = sums.where((nx >= least) & (ny >= least))
    return _done(enough, u / (nx * ny), F.when(variance > TINY, (u - nx * ny / 2 - 0.5) / F.sqrt(variance)))


def causal_impact(steps: DataFrame, events: DataFrame, window: int, least: int = 5, least_pre: int = 10) -> DataFrame:
    """The sum by which support in the event exceeds the trend before it."""
    part = F.col("part")
    rows = _moments(_parts(steps, events, window), {"pre": part == "pre", "during": part == "during"})
    rows = rows.where((F.col("during_n") >= least) & (F.col("pre_n") >= least_pre))
    pre, nd = _line("pre"), F.col("during_n")
    effect = F.col("during_y") - pre["level"] * nd - pre["slope"] * F.col("during_t")
    error = F.sqrt(pre["ssr"] / F.greatest(F.lit(1.0), pre["n"] - 2)) * F.sqrt(nd * (1 + nd / pre["n"]))
    return _done(rows, effect, F.when(error >= TINY, effect / error))


def interrupted(steps: DataFrame, events: DataFrame, window: int, least: int = 10) -> DataFrame:
    """Interrupted time series, the jump of level at the event's start.

    The regression with an own level and slope inside the event is two separate
    lines, so no matrix is inverted.
    """
    inside = F.col("part") == "during"
    rows = _moments(_parts(steps, events, window), {"out": ~inside, "in": inside})
    rows = rows.where((F.col("in_n") >= least) & (F.col("out_n") >= least))
    a, b = _line("out"), _line("in")
    effect = b["level"] - a["level"]  # time 0 is the event's start
    spread = sum((1 / g["n"] + g["mean_t"] * g["mean_t"] / g["sxx"] for g in (a, b)), F.lit(0.0))
    variance = (a["ssr"] + b["ssr"]) / (a["n"] + b["n"] - 4) * spread
    return _done(rows, effect, F.when(variance > TINY * TINY, effect / F.sqrt(variance)))


def event_study(steps: DataFrame, events: DataFrame, window: int, least: int = 5, least_pre: int = 10) -> DataFrame:
    """Cumulative abnormal support against mean and deviation before the event."""
    part = F.col("part")
    rows = _moments(_parts(steps, events, window), {"pre": part == "pre", "during": part == "during"})
    rows = rows.where((F.col("during_n") >= least) & (F.col("pre_n") >= least_pre))
    n, mean = F.col("pre_n"), F.col("pre_y") / F.col("pre_n")
    sigma = F.sqrt(F.greatest(F.col("pre_yy") / n - mean * mean, F.lit(0.0)))
    effect = F.col("during_y") - F.col("during_n") * mean
    return _done(rows, effect, F.when(sigma >= 1e-6, effect / (sigma * F.sqrt(F.col("during_n")))))


def coincidence(intervals: DataFrame, events: DataFrame, window: int, n: int, least: int = 3, convention: str = "bag") -> DataFrame:
    """Event coincidence: change points within a window of the event against a uniform rate."""
    points = bare(intervals, window, n, convention)
    enough = points.groupBy("pattern").agg(F.count("*").cast("double").alias("m")).where(F.col("m") >= least)
    near = points.join(enough, "pattern").join(bounded(events), F.lit(True))
    hit = (F.col("time") >= F.col("start") - window) & (F.col("time") <= F.col("end") + window)
    rows = near.groupBy(*KEYS).agg(F.first("m").alias("m"), F.sum(F.when(hit, 1.0).otherwise(0.0)).alias("k"))
    rate = F.least(F.lit(1.0), (F.col("end") - F.col("start") + 1 + 2 * window) / F.lit(float(n)))
    variance = F.col("m") * rate * (1 - rate)
    return _done(rows, F.col("k"), F.when(variance > TINY, (F.col("k") - F.col("m") * rate) / F.sqrt(variance)))


def contrast(times: DataFrame, events: DataFrame, n: int, least: int = 5) -> DataFrame:
    """Emerging patterns: the share of transactions with the pattern inside the event against outside."""
    rows = times.join(bounded(events), F.lit(True))
    inside = (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end"))
    rows = rows.groupBy(*KEYS).agg(F.sum(F.when(inside, 1.0).otherwise(0.0)).alias("x"), F.sum(F.when(inside, 0.0).otherwise(1.0)).alias("y"))
    n1 = (F.col("end") - F.col("start") + 1).cast("double")
    n2 = F.lit(float(n)) - n1
    p1, p2 = F.col("x") / n1, F.col("y") / n2
    pooled = (F.col("x") + F.col("y")) / F.lit(float(n))
    variance = pooled * (1 - pooled) * (1 / n1 + 1 / n2)
    return _done(rows.where((n1 >= least) & (n2 >= least)), p1 - p2, F.when(variance > TINY, (p1 - p2) / F.sqrt(variance)))


def finished(tested: DataFrame, alpha: float = 0.1, deduplicate: bool = False) -> DataFrame:
    """Benjamini-Hochberg over all tests, the cut, and on demand G3."""
    found = significant(benjamini_hochberg(tested), alpha).withColumnRenamed("name", "event_name")
    return by_p(found) if deduplicate else found
