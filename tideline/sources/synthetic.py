"""Synthetic baskets with planted, unrelated and decoy signals.

Every random number is a hash of the seed, the place and the item, so data does
not depend on partitions, and any part can be made again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Planted:
    """Items that come together inside an event with chance ``boost``, and outside with the base chance each."""

    pattern: tuple[int, ...]
    event_id: str
    name: str
    start: int
    end: int
    boost: float


@dataclass(frozen=True)
class Unrelated:
    """Items that come together in an active period without an event."""

    pattern: tuple[int, ...]
    start: int
    end: int
    boost: float


@dataclass(frozen=True)
class Decoy:
    """An event without any effect."""

    event_id: str
    name: str
    start: int
    end: int


@dataclass(frozen=True)
class Scenario:
    n: int = 5000
    items: int = 200
    base: float = 0.03
    planted: tuple[Planted, ...] = ()
    unrelated: tuple[Unrelated, ...] = ()
    decoys: tuple[Decoy, ...] = ()
    pairs: tuple[tuple[int, int, float], ...] = ()
    zipf: float | None = None
    zipf_max: float = 0.10
    seed: int = 0
    extra: dict = field(default_factory=dict)


def uniform(seed: int, *parts: Column | str | int) -> Column:
    """A number in [0, 1) by hash of the seed and parts: the first 52 bits of an MD5 sum, which SQL can repeat."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in (seed, *parts)]
    digest = F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") * F.lit(2.0**-52)


def zipf_chances(spark: SparkSession, items: int, alpha: float = 1.0, median: float = 0.03, most: float = 0.10) -> DataFrame:
    """``(item, p)`` with p = min(C / item^alpha, most), C so that the middle item has ``median``."""
    c = median * (items / 2) ** alpha
    return spark.range(1, items + 1).select(F.col("id").alias("item"), F.least(F.lit(c) / F.pow(F.col("id").cast("double"), F.lit(alpha)), F.lit(most)).alias("p"))


def rescaled(scenario: Scenario, n: int) -> Scenario:
    """Places in proportion to a new length, halves rounded up."""
    at = lambda x: int(x * n / scenario.n + 0.5)
    move = lambda xs: tuple(replace(x, start=at(x.start), end=at(x.end)) for x in xs)
    return replace(scenario, n=n, planted=move(scenario.planted), unrelated=move(scenario.unrelated), decoys=move(scenario.decoys))


def _together(axis: DataFrame, seed: int, tag: str, pattern: tuple[int, ...], start: int, end: int, boost: float) -> DataFrame:
    hit = axis.where((F.col("t") >= start) & (F.col("t") <= end) & (uniform(seed, tag, F.col("t")) < min(1.0, boost)))
    return hit.select("t", F.explode(F.array(*(F.lit(x).cast("long") for x in pattern))).alias("item"))


def occurrences(spark: SparkSession, scenario: Scenario) -> DataFrame:
    """``(t, item)`` without repeats."""
    axis = spark.range(scenario.n).select(F.col("id").alias("t"))
    if scenario.zipf is None:
        chances = spark.range(1, scenario.items + 1).select(F.col("id").alias("item"), F.lit(scenario.base).alias("p"))
    else:
        chances = zipf_chances(spark, scenario.items, scenario.zipf, scenario.base, scenario.zipf_max)
    made = axis.join(F.broadcast(chances), uniform(scenario.seed, "base", F.col("t"), F.col("item")) < F.col("p")).select("t", "item")
    for k, x in enumerate(scenario.planted):
        made = made.unionByName(_together(axis, scenario.seed, f"planted{k}", x.pattern, x.start, x.end, x.boost))
        outside = [i for i in x.pattern if i > scenario.items]
        if outside:  # items that the base doesn't have
            rare = axis.where((F.col("t") < x.start) | (F.col("t") > x.end)).select("t", F.explode(F.array(*(F.lit(i).cast("long") for i in outside))).alias("item"))
            made = made.unionByName(rare.where(uniform(scenario.seed, f"rare{k}", F.col("t"), F.col("item")) < scenario.base))
    for k, x in enumerate(scenario.unrelated):
        made = made.unionByName(_together(axis, scenario.seed, f"unrelated{k}", x.pattern, x.start, x.end, x.boost))
    for k, (a, b, p) in enumerate(scenario.pairs):
        with_a = made.where(F.col("item") == a).select("t").distinct().where(uniform(scenario.seed, f"pair{k}", F.col("t")) < p)
        made = made.unionByName(with_a.select("t", F.lit(b).cast("long").alias("item")))
    return made.distinct()


def events(spark: SparkSession, scenario: Scenario) -> DataFrame:
    """Planted events and decoys."""
    rows = {(x.event_id, x.name, x.start, x.end) for x in (*scenario.planted, *scenario.decoys)}
    return spark.createDataFrame(sorted(rows), "event_id string, name string, start long, end long")


def unrelated(spark: SparkSession, scenario: Scenario) -> DataFrame:
    return spark.createDataFrame([(sorted(x.pattern), x.start, x.end, x.boost) for x in scenario.unrelated], "pattern array<long>, active_start long, active_end long, boost_factor double")


def ground_truth(spark: SparkSession, scenario: Scenario, dense: DataFrame, convention: str = "longest") -> DataFrame:
    """Y2: mined intervals of planted patterns that meet their event: the ``longest`` (first on a tie), or ``all``."""
    planted = spark.createDataFrame([(sorted(x.pattern), x.event_id, x.start, x.end) for x in scenario.planted], "pattern array<long>, event_id string, start long, end long")
    met = dense.join(F.broadcast(planted), "pattern").where((F.col("s") <= F.col("end")) & (F.col("e") >= F.col("start")))
    if convention == "all":
        return met.select("pattern", "event_id", F.col("s").alias("interval_start"), F.col("e").alias("interval_end"))
    best = F.max_by(F.struct("s", "e"), F.struct(F.col("e") - F.col("s"), -F.col("s")))
    return met.groupBy("pattern", "event_id").agg(best.alias("x")).select("pattern", "event_id", F.col("x.s").alias("interval_start"), F.col("x.e").alias("interval_end"))


def injected(occ: DataFrame, planted: list[Planted], seed: int = 0, share: float = 0.3) -> DataFrame:
    """Real ``(t, item)`` with planted items added inside events, each by itself with chance ``boost * share``; transactions without items stay empty."""
    times = occ.select("t").distinct()
    made = occ.select("t", "item")
    for k, x in enumerate(planted):
        inside = times.where((F.col("t") >= x.start) & (F.col("t") <= x.end)).select("t", F.explode(F.array(*(F.lit(i).cast("long") for i in x.pattern))).alias("item"))
        made = made.unionByName(inside.where(uniform(seed, f"inject{k}", F.col("t"), F.col("item")) < min(1.0, x.boost * share)))
    return made.distinct()


# --- Y5, Y6: scenarios at 5,000 transactions; rescaled() takes them to other lengths.

def _event(k: int, pattern: tuple[int, ...], start: int, end: int, boost: float) -> Planted:
    return Planted(pattern, f"E{k}", f"event_{k}", start, end, boost)


PATTERNS = ((5, 15), (25, 35), (45, 55), (201, 202, 203), (205, 206, 207, 208))


def beta(boost: float = 0.3, seed: int = 0) -> Scenario:
    """Five planted patterns with an event of 300 each, two unrelated patterns, two decoys."""
    starts = (400, 1200, 2000, 2800, 3600)
    planted = tuple(_event(k + 1, p, a, a + 299, boost) for k, (p, a) in enumerate(zip(PATTERNS, starts)))
    other = (Unrelated((65, 75), 800, 1099, boost), Unrelated((85, 95), 4300, 4599, boost))
    return Scenario(planted=planted, unrelated=other, decoys=(Decoy("D1", "decoy_1", 1650, 1849), Decoy("D2", "decoy_2", 4700, 4899)), seed=seed)


def overlapping(boost: float = 0.3, seed: int = 0) -> Scenario:
    """Events that overlap in time."""
    planted = (_event(1, PATTERNS[0], 800, 1400, boost), _event(2, PATTERNS[1], 1100, 1700, boost), _event(3, PATTERNS[2], 3000, 3600, boost))
    return replace(beta(boost, seed), planted=planted)


def confounded(boost: float = 0.3, seed: int = 0) -> Scenario:
    """Unrelated patterns that are active during events."""
    own = beta(boost, seed)
    return replace(own, unrelated=tuple(Unrelated(u.pattern, p.start, p.end, boost) for u, p in zip(own.unrelated, own.planted)))


def crowded(boost: float = 0.3, seed: int = 0) -> Scenario:
    """Six planted patterns close to each other."""
    patterns = (*PATTERNS, (105, 115))
    return replace(beta(boost, seed), planted=tuple(_event(k + 1, p, 300 + 750 * k, 599 + 750 * k, boost) for k, p in enumerate(patterns)))


def short(boost: float = 0.3, seed: int = 0) -> Scenario:
    """Short events of 80."""
    own = beta(boost, seed)
    return replace(own, planted=tuple(replace(p, end=p.start + 79) for p in own.planted))


def zipf(boost: float = 0.3, seed: int = 0, correlated: bool = False) -> Scenario:
    """Item chances by Zipf's law, and on demand five pairs that go together."""
    pairs = tuple((10 + 20 * k, 12 + 20 * k, 0.3) for k in range(5)) if correlated else ()
    return replace(beta(boost, seed), zipf=1.0, pairs=pairs)


def null(seed: int = 0, n: int = 100_000) -> Scenario:
    """Dense patterns and far decoys, no planted ones."""
    own = Scenario(n=5000, unrelated=tuple(Unrelated((5 + 20 * k, 15 + 20 * k), 500 + 1000 * k, 799 + 1000 * k, 0.3) for k in range(4)), decoys=tuple(Decoy(f"D{k}", f"decoy_{k}", 50 + 950 * k, 150 + 950 * k) for k in range(5)), seed=seed)
    return rescaled(own, n)


def two_intervals(seed: int = 0, n: int = 100_000) -> Scenario:
    """One pattern, dense twice; one of the times has an event."""
    own = Scenario(planted=(_event(1, (5, 15), 1000, 1299, 0.3),), unrelated=(Unrelated((5, 15), 3500, 3799, 0.3),), decoys=(Decoy("D1", "decoy_1", 2400, 2599),), seed=seed)
    return rescaled(own, n)


def two_boosts(seed: int = 0, n: int = 100_000) -> Scenario:
    """One pattern with a strong and a weak event."""
    own = Scenario(planted=(_event(1, (5, 15), 1000, 1299, 0.5), _event(2, (5, 15), 3500, 3799, 0.1)), seed=seed)
    return rescaled(own, n)


def by_length(length: int, seed: int = 0, n: int = 100_000) -> Scenario:
    """Three planted patterns of a length."""
    planted = tuple(_event(k + 1, tuple(range(201 + 10 * k, 201 + 10 * k + length)), 700 + 1500 * k, 999 + 1500 * k, 0.3) for k in range(3))
    return rescaled(Scenario(planted=planted, seed=seed), n)


def tiny(seed: int = 0) -> Scenario:
    """Fifty transactions of ten items, {1, 2} planted on [10, 25]."""
    return Scenario(n=50, items=10, base=0.05, planted=(_event(1, (1, 2), 10, 25, 0.9),), seed=seed)
