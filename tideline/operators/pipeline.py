"""Attribution end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut, store
from tideline.operators import attribution, baselines, changes
from tideline.operators.correction import corrected, significant
from tideline.operators.dedup import best_per_pair, by_score
from tideline.operators.postings import timestamps
from tideline.operators.support import positions


@dataclass(frozen=True)
class Config:
    """Parameters of an attribution run; ``sigma`` is the window where it is not given."""

    window: int
    theta: int
    sigma: float | None = None
    level: int = 20
    threshold: float = 0.1
    normalisation: str = "sqrt"
    ablation: str | None = None
    permutations: int = 1000
    alpha: float = 0.05
    correction: str = "bh"
    deduplicate: bool = False
    global_correction: bool = True
    unit: str = "interval"
    min_length: int = 2
    min_range: int = 0
    min_magnitude: float = 0.0
    min_relative: float = 0.0
    change_method: str = "intervals"
    drift: float = 0.5
    bound: float = 4.0
    seed: int | None = None
    independent: bool = False


def attribute(dense: DataFrame, occ: DataFrame, events: DataFrame, n: int, config: Config, times: DataFrame | None = None) -> DataFrame:
    """Significant attributions of ``dense`` patterns to ``events``.

    ``unit='interval'`` tests each interval of a pattern against each event,
    ``unit='pattern'`` pools a pattern's intervals. With ``change_method``
    ``threshold_crossing`` or ``cusum`` the change points come from the support
    series (A11), and the unit is the pattern. ``times``: the transactions of
    the patterns (:func:`timestamps`), if they are there already.
    """
    top = positions(config.window, n)
    chosen = dense.where(F.size("pattern") >= config.min_length).select("pattern", "s", "e")
    times = store(timestamps(occ, chosen)) if times is None else times
    if config.min_range > 0:
        chosen = chosen.join(changes.sampled_range(chosen, times, config.window, n, config.min_range), "pattern", "left_semi")
    if config.change_method == "intervals":
        points = changes.from_intervals(chosen, times, config.window, n, config.level)
        unit = ("pattern", "s", "e") if config.unit == "interval" else ("pattern",)
    else:
        points = changes.detect(times, chosen, config.window, n, config.change_method, theta=config.theta, level=config.level, drift=config.drift, bound=config.bound)
        points = points.withColumns({"s": F.lit(None).cast("long"), "e": F.lit(None).cast("long")})
        unit = ("pattern",)
    points = cut(changes.strong(points, config.min_magnitude, config.min_relative))
    sigma = float(config.window if config.sigma is None else config.sigma)
    same = {"normalisation": config.normalisation, "ablation": config.ablation, "threshold": config.threshold}
    tested = cut(attribution.permutation_test(points, events, top, sigma, permutations=config.permutations, unit=unit, seed=config.seed, independent=config.independent, **same))
    groups = () if config.global_correction else ("pattern",)
    kept = significant(corrected(tested, config.correction, "p_value", *groups), config.alpha)
    at = attribution.representatives(attribution.score(points, events, sigma, **same), *unit).select(*unit, "event_id", "at")
    rows = kept.join(at, [*unit, "event_id"]).join(F.broadcast(events), "event_id")
    rows = rows.select(
        "pattern", F.col("at.s").alias("interval_start"), F.col("at.e").alias("interval_end"), F.col("at.time").alias("time"), F.col("at.direction").alias("direction"), F.col("at.magnitude").alias("magnitude"),
        "event_id", F.col("name").alias("event_name"), F.col("start").alias("event_start"), F.col("end").alias("event_end"), F.col("at.proximity").alias("proximity"), F.col("observed").alias("score"), "p_value", "adjusted",
    )
    if config.deduplicate:
        rows = by_score(rows, ["pattern", "event_name", "interval_start", "interval_end"])
    return rows


def baseline(method: str, dense: DataFrame, occ: DataFrame, events: DataFrame, n: int, config: Config) -> DataFrame:
    """One of the baseline tests by name, corrected and cut."""
    from tideline.operators.support import steps

    chosen = dense.where(F.size("pattern") >= 2).select("pattern", "s", "e")
    times = cut(timestamps(occ, chosen))
    if method in ("coincidence", "contrast"):
        tested = baselines.coincidence(chosen, events, config.window, n) if method == "coincidence" else baselines.contrast(times, events, n)
    elif method in baselines.METHODS:
        stretches = steps(times, chosen, config.window, n)
        if config.min_range > 0:
            stretches = stretches.join(changes.sampled_range(chosen, times, config.window, n, config.min_range), "pattern", "left_semi")
        tested = getattr(baselines, method)(stretches, events, config.window)
    else:
        raise ValueError(f"no baseline {method}")
    return baselines.finished(cut(tested), config.alpha, config.deduplicate)


def predictions(attributed: DataFrame) -> DataFrame:
    """One row for each pattern and event, as evaluation takes it."""
    return best_per_pair(attributed)
