"""Scores of events for change points, and their permutation test.

Events are rows ``(event_id, name, start, end)``, inclusive on the index axis.
A score falls with the distance to the nearer boundary of an event, so a change
point only reaches so far: points and boundaries meet in buckets of the axis, as
wide as two sigma, and never all with all. The number of events and of their
shifts isn't bounded; they are broadcast if a count allows it, else shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.operators.postings import SEND_ROWS, small

NORMALISATIONS = ("none", "sqrt", "full")
#: Places to which scores are rounded before they are compared.
DIGITS = 9


def bounded(frame: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """A side that every row meets: broadcast, and refused beyond ``most`` rows."""
    if frame.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to compare everything with")
    return F.broadcast(frame)


def proximity(time: Column, start: Column, end: Column, sigma: float) -> Column:
    """A1: ``exp(-d / sigma)`` by the distance to the nearer boundary; without sigma, whether that is 0."""
    d = F.least(F.abs(time - start), F.abs(time - end))
    return F.exp(-d / F.lit(float(sigma))) if sigma > 0 else F.when(d == 0, 1.0).otherwise(0.0)


def normalised(magnitude: Column, before: Column, mode: str = "sqrt") -> Column:
    """A2: the magnitude in relation to the support before."""
    if mode not in NORMALISATIONS:
        raise ValueError(f"no normalisation {mode}")
    base = F.greatest(F.lit(1.0), before)
    return {"none": magnitude, "sqrt": magnitude / F.sqrt(base), "full": magnitude / base}[mode]


def _reach(weight: Column, sigma: float, threshold: float, ablation: str | None) -> Column:
    """The greatest distance at which a score can still come to ``threshold``, and a little more for rounding."""
    if sigma <= 0:
        return F.lit(0.0)
    most = F.lit(1.0) if ablation == "no_mag" else weight
    return F.when(most * 2 >= threshold, F.lit(float(sigma)) * F.log(F.greatest(most / threshold, F.lit(1.0))) + 1.0)


def _met(points: DataFrame, events: DataFrame, sigma: float, threshold: float, ablation: str | None, on: list[str]) -> DataFrame:
    """Points (``time, weight``) with each event (``start, end``) within their reach, equal in ``on``.

    Both boundaries of an event have a bucket; a point looks into the buckets
    that it reaches, and meets an event in the bucket of its nearer boundary.
    """
    wide = max(1, int(-(-2 * sigma // 1)))
    bucket = lambda c: F.floor(c / wide)
    ends = events.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("start")), bucket(F.col("end"))))))
    look = points.withColumn("__reach", _reach(F.col("weight"), sigma, threshold, ablation)).where("__reach is not null")
    # no boundary lies outside of the buckets that there are
    low, high = ends.agg(F.min("__bucket"), F.max("__bucket")).first()
    if low is None:
        look, low, high = look.limit(0), 0, 0
    first, last = F.greatest(bucket(F.col("time") - F.col("__reach")), F.lit(low)), F.least(bucket(F.col("time") + F.col("__reach")), F.lit(high))
    look = look.where(first <= last).withColumn("__bucket", F.explode(F.sequence(first, last)))
    nearer = F.when(F.abs(F.col("time") - F.col("start")) <= F.abs(F.col("time") - F.col("end")), F.col("start")).otherwise(F.col("end"))
    return look.join(ends, [*on, "__bucket"]).where(F.col("__bucket") == bucket(nearer)).drop("__bucket", "__reach")


def score(points: DataFrame, events: DataFrame, sigma: float, *, normalisation: str = "sqrt", ablation: str | None = None, threshold: float = 0.1) -> DataFrame:
    """Each change point with each event: ``proximity`` and ``score`` of ``threshold`` or more (above 0).

    ``ablation``: ``no_prox`` scores by magnitude alone, whatever the distance,
    so its result has every point with every event, which must be ``SEND_ROWS``
    at most; ``no_mag`` scores by proximity alone.
    """
    if ablation not in (None, "no_prox", "no_mag") or threshold <= 0:
        raise ValueError(f"no ablation {ablation}, or a threshold of 0")
    sized = points.withColumn("weight", normalised(F.col("magnitude"), F.col("before"), normalisation))
    near = proximity(F.col("time"), F.col("start"), F.col("end"), sigma)
    value = {None: F.col("proximity") * F.col("weight"), "no_prox": F.col("weight"), "no_mag": F.col("proximity")}[ablation]
    if ablation == "no_prox":
        met = sized.where(F.round("weight", DIGITS) >= threshold).join(bounded(events), F.lit(True))
    else:
        met = _met(sized, small(cut(events)), sigma, threshold, ablation, [])
    return met.withColumn("proximity", near).withColumn("score", F.round(value, DIGITS)).where(F.col("score") >= threshold)


def observed(scored: DataFrame, *unit: str) -> DataFrame:
    """A4: the sum of scores for each hypothesis (``unit`` and event)."""
    return scored.groupBy(*unit, "event_id").agg(F.round(F.sum("score"), DIGITS).alias("observed"))


def shifted(start: Column, end: Column, offset: Column, top: int) -> tuple[Column, Column]:
    """A5: an event moved on by ``offset`` around the axis; its end is cut off at the last position."""
    begin = F.pmod(start + offset, F.lit(top))
    return begin, F.least(begin + (end - start), F.lit(top - 1))


def offsets(spark, permutations: int, top: int, seed: int | None = None) -> DataFrame:
    """``(b, offset)``, the same shifts for all hypotheses: seeded, or without a seed a fixed sweep of 1 .. top - 1."""
    if top <= 1:
        return spark.createDataFrame([], "b int, offset long")
    if seed is None:
        return spark.range(permutations).select(F.col("id").cast("int").alias("b"), (1 + (F.col("id") * 7919 + 104729) % (top - 1)).alias("offset"))
    draw = random.Random(seed)
    return spark.createDataFrame([(b, draw.randint(1, top - 1)) for b in range(permutations)], "b int, offset long")


def own_offset(unit: Sequence[str], b: Column, top: int, seed: int) -> Column:
    """The shift of a hypothesis (``unit`` and event) with its own random numbers: 52 bits of an MD5 sum of its name, the seed and ``b``."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in unit), F.col("event_id"), b.cast("string")))
    return 1 + F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.lit(top - 1)


def permutation_test(points: DataFrame, events: DataFrame, top: int, sigma: float, *, permutations: int = 1000, unit: tuple[str, ...] = ("pattern", "s", "e"), seed: int | None = None, independent: bool = False, normalisation: str = "sqrt", ablation: str | None = None, threshold: float = 0.1) -> DataFrame:
    """``(unit..., event_id, observed, p_value)``.

    Every shift moves all events at once; with ``independent``, each hypothesis
    has shifts of its own (:func:`own_offset`). p is (1 + the number of shifts
    with a sum at least as large) / (1 + shifts). Hypotheses without any score
    are none. Without proximity (``no_prox``) no shift changes a sum, and p is 1.
    No result if the axis has at most one position.
    """
    spark = points.sparkSession
    if top <= 1:
        return points.select(*unit).limit(0).select(*unit, F.lit("").alias("event_id"), F.lit(0.0).alias("observed"), F.lit(1.0).alias("p_value"))
    seen = cut(observed(score(points, events, sigma, normalisation=normalisation, ablation=ablation, threshold=threshold), *unit))
    if ablation == "no_prox":
        return seen.withColumn("p_value", F.lit(1.0))
    sized = points.select(*unit, "time", normalised(F.col("magnitude"), F.col("before"), normalisation).alias("weight"))
    value = {None: F.col("proximity") * F.col("weight"), "no_mag": F.col("proximity")}[ablation]
    begin, end = shifted(F.col("start"), F.col("end"), F.col("offset"), top)
    bounds = events.select("event_id", "start", "end")
    spread = sized.join(seen.select(*unit, "event_id"), list(unit))
    if independent:
        # as many rows as hypotheses and shifts: each is a random number of its own
        own = seen.select(*unit, "event_id").join(small(cut(bounds)), "event_id").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        moves = own.withColumn("offset", own_offset(unit, F.col("b"), top, seed or 0)).select(*unit, "event_id", "b", begin.alias("start"), end.alias("end"))
        met = _met(spread, moves, sigma, threshold, ablation, [*unit, "event_id"])
    else:
        moves = bounds.join(F.broadcast(offsets(spark, permutations, top, seed)), F.lit(True))
        met = _met(spread, small(cut(moves.select("event_id", "b", begin.alias("start"), end.alias("end"))), 10 * SEND_ROWS), sigma, threshold, ablation, ["event_id"])
    moved = met.withColumn("proximity", proximity(F.col("time"), F.col("start"), F.col("end"), sigma)).withColumn("score", F.round(value, DIGITS)).where(F.col("score") >= threshold)
    sums = moved.groupBy(*unit, "event_id", "b").agg(F.round(F.sum("score"), DIGITS).alias("sum"))
    counts = sums.join(seen, [*unit, "event_id"]).where(F.col("sum") >= F.col("observed")).groupBy(*unit, "event_id").agg(F.count("*").alias("n"))
    p = (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(permutations + 1))
    return seen.join(counts, [*unit, "event_id"], "left").select(*unit, "event_id", "observed", p.alias("p_value"))


def representatives(scored: DataFrame, *unit: str) -> DataFrame:
    """For each hypothesis the change point of highest score (then earliest), with its interval."""
    best = F.max_by(F.struct("time", "direction", "magnitude", "proximity", "score", "s", "e"), F.struct("score", -F.col("time"), "direction"))
    return scored.groupBy(*unit, "event_id").agg(best.alias("at"))


def within_pattern(tested: DataFrame) -> DataFrame:
    """A10: Bonferroni among the hypotheses of a pattern."""
    m = F.count("*").over(Window.partitionBy("pattern"))
    return tested.withColumn("adjusted", F.least(F.lit(1.0), F.col("p_value") * m))


def naive(points: DataFrame, events: DataFrame, sigma: float, **options) -> DataFrame:
    """The pairs of pattern and event that have any score, with the first change point that does."""
    scored = score(points, events, sigma, **options)
    first = F.min_by(F.struct("time", "direction", "score"), F.struct("s", "time", "direction"))
    return scored.groupBy("pattern", F.col("name").alias("event_name")).agg(first.alias("x")).select("pattern", "event_name", "x.*")
