"""Tolerant relations between dense intervals and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.attribution import bounded


def relations(intervals: DataFrame, events: DataFrame, epsilon: int, least: int) -> DataFrame:
    """``(pattern, s, e, event_id, relation, overlap)``: each of six relations that holds, within ``epsilon``.

    ``overlap`` is the common length for the two overlap relations, which need
    ``least`` less the tolerance, and null for the others.
    """
    s, e, a, b = F.col("s"), F.col("e"), F.col("start"), F.col("end")
    none = F.lit(None).cast("long")
    cases = [
        ("DenseFollowsEvent", (e - epsilon <= a) & (a <= e + epsilon), none),
        ("EventFollowsDense", (b - epsilon <= s) & (s <= b + epsilon), none),
        ("DenseContainsEvent", (s <= a) & (e + epsilon >= b), none),
        ("EventContainsDense", (a <= s) & (b + epsilon >= e), none),
        ("DenseOverlapsEvent", (s < a) & (e - a >= least - epsilon) & (e < b + epsilon), e - a),
        ("EventOverlapsDense", (a < s) & (b - s >= least - epsilon) & (b < e + epsilon), b - s),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("relation"), size.alias("overlap"))) for name, test, size in cases)))
    near = intervals.join(bounded(events), (a <= e + epsilon) & (b >= s - epsilon))
    return near.select("pattern", "s", "e", "event_id", F.explode(found).alias("x")).select("pattern", "s", "e", "event_id", "x.*")
