"""Evaluation against ground truth, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.operators.correction import benjamini_hochberg
from tideline.operators.intervals import merge, overlap
from tideline.operators.postings import small


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns({"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)})


def _compared(predicted: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    sets = predicted.distinct().withColumn("p", F.lit(1)).unionByName(truth.distinct().withColumn("p", F.lit(2)))
    keys = [c for c in predicted.columns]
    met = sets.groupBy(*keys).agg(F.sum("p").alias("p"))
    count = lambda v: F.coalesce(F.sum(F.when(F.col("p") == v, 1)), F.lit(0)).cast("long")
    return _rates(met.groupBy(*by).agg(count(3).alias("tp"), count(1).alias("fp"), count(2).alias("fn")))


def with_ids(predicted: DataFrame, events: DataFrame) -> DataFrame:
    """Event names to ids, the last id of a repeated name; an unknown name stays as it is."""
    ids = events.groupBy(F.col("name").alias("event_name")).agg(F.max("event_id").alias("__id"))
    return predicted.join(small(cut(ids)), "event_name", "left").withColumn("event_id", F.coalesce("__id", "event_name")).drop("__id")


def intervals_and_events(predicted: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """Precision, recall and F1 over sets of (pattern, interval, event); intervals count only if the truth has any."""
    named = with_ids(predicted, events).select(F.array_sort("pattern").alias("pattern"), "event_id", F.col("interval_start").alias("s"), F.col("interval_end").alias("e"))
    known = truth.select(F.array_sort("pattern").alias("pattern"), "event_id", F.coalesce("interval_start", F.lit(0)).cast("long").alias("s"), F.coalesce("interval_end", F.lit(0)).cast("long").alias("e"))
    if known.where("s <> 0 or e <> 0").isEmpty():
        named = named.withColumns({"s": F.lit(0).cast("long"), "e": F.lit(0).cast("long")})
    return _compared(named, known)


def patterns_and_events(predicted: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """The same over sets of (pattern, event)."""
    named = with_ids(predicted, events).select(F.array_sort("pattern").alias("pattern"), "event_id")
    return _compared(named, truth.select(F.array_sort("pattern").alias("pattern"), "event_id"))


def false_attribution(predicted: DataFrame, unrelated: DataFrame) -> DataFrame:
    """The share of unrelated patterns that are predicted."""
    own = unrelated.select(F.array_sort("pattern").alias("pattern")).distinct()
    hit = predicted.select(F.array_sort("pattern").alias("pattern")).distinct().withColumn("hit", F.lit(1))
    met = own.join(hit, "pattern", "left").agg(F.count("*").alias("n_unrelated"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_false"))
    return met.withColumn("rate", F.col("n_false") / F.greatest(F.lit(1), F.col("n_unrelated")))


def means(results: DataFrame, *keys: str, values: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Means over seeds."""
    return results.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def confidence(results: DataFrame, value: str, *keys: str, quantile: float = 2.093) -> DataFrame:
    """E5: mean, deviation, standard error and interval within 0 and 1; the quantile is that of 20 runs. Fewer than two runs: zeros."""
    made = results.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("d"))
    enough = F.col("n") >= 2
    some = lambda c: F.when(enough, c).otherwise(F.lit(0.0))
    se = F.col("d") / F.sqrt(F.col("n").cast("double"))
    return made.select(*keys, "n", some(F.col("m")).alias("mean"), some(F.col("d")).alias("sd"), some(se).alias("se"), some(F.greatest(F.lit(0.0), F.col("m") - quantile * se)).alias("low"), some(F.least(F.lit(1.0), F.col("m") + quantile * se)).alias("high"))


def null_discoveries(per_seed: DataFrame) -> DataFrame:
    """From ``(seed, n_predicted)`` without any true effect: how many seeds have a discovery, and their share."""
    some = F.sum(F.when(F.col("n_predicted") > 0, 1).otherwise(0))
    return per_seed.agg(F.count("*").alias("seeds"), some.alias("seeds_with_false"), (some / F.count("*")).alias("fdr"))


def of_type(events: DataFrame, kind: str = "TypeA") -> DataFrame:
    """events whose name contains ``kind``."""
    return events.where(F.col("name").contains(kind))


def number_of(event_id: Column | str) -> Column:
    """the number in an id such as C8; -1 if there is none."""
    return F.coalesce(F.expr(f"try_cast(regexp_replace({event_id}, '^C+', '') as bigint)") if isinstance(event_id, str) else F.regexp_replace(event_id, "^C+", "").try_cast("bigint"), F.lit(-1).cast("long"))


def coupon_consistency(attributed: DataFrame, coupons: DataFrame) -> DataFrame:
    """Whether any item of an attributed pattern is among its campaign's coupon items (``campaign, item``)."""
    rows = attributed.select("pattern", "event_id", number_of("event_id").alias("campaign")).distinct()
    items = rows.select("pattern", "event_id", "campaign", F.explode("pattern").alias("item"))
    hit = items.join(coupons.select("campaign", "item").distinct(), ["campaign", "item"], "left_semi").select("pattern", "event_id").distinct().withColumn("coupon_consistent", F.lit(True))
    return rows.join(hit, ["pattern", "event_id"], "left").select("pattern", "event_id", "campaign", F.coalesce("coupon_consistent", F.lit(False)).alias("coupon_consistent"))


def consistency_rate(checked: DataFrame) -> DataFrame:
    """Consistent, total and their ratio (0 if there are none)."""
    yes, total = F.sum(F.when(F.col("coupon_consistent"), 1).otherwise(0)), F.count("*")
    return checked.agg(F.coalesce(yes, F.lit(0)).alias("consistent"), total.alias("total")).withColumn("rate", _ratio(F.col("consistent"), F.col("total")))


def named_items(items: DataFrame, commodities: DataFrame) -> DataFrame:
    """The commodity of each item, or ``ID:`` and its number."""
    return items.join(commodities.select("item", "commodity"), "item", "left").withColumn("commodity", F.coalesce("commodity", F.concat(F.lit("ID:"), F.col("item").cast("string"))))


def top_per_event(attributed: DataFrame, events: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` highest scores of each event; events without any are kept, with rank 0."""
    order = Window.partitionBy("event_id").orderBy(F.desc("score"), "pattern")
    ranked = attributed.select("event_id", "pattern", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return events.select("event_id").join(ranked, "event_id", "left").select("event_id", F.coalesce("rank", F.lit(0)).alias("rank"), "pattern", F.coalesce("score", F.lit(0.0)).alias("score"))


def funnel(dense: DataFrame, points: DataFrame, events: DataFrame, passing: DataFrame) -> DataFrame:
    """How many patterns there are, of two items or more, past the filter, with change points, and hypotheses."""
    patterns = dense.select("pattern").distinct()
    longer = patterns.where(F.size("pattern") >= 2)
    counts = patterns.agg(F.count("*").alias("patterns")).join(longer.agg(F.count("*").alias("longer")), F.lit(True))
    counts = counts.join(passing.select("pattern").distinct().agg(F.count("*").alias("passing")), F.lit(True))
    changed = points.join(passing.select("pattern").distinct(), "pattern", "left_semi").select("pattern").distinct()
    counts = counts.join(changed.agg(F.count("*").alias("with_changes")), F.lit(True)).join(events.agg(F.count("*").alias("events")), F.lit(True))
    return counts.withColumn("hypotheses", F.col("with_changes") * F.col("events"))


def range_sweep(steps: DataFrame, deltas: tuple[int, ...] = (0, 1, 2, 3, 5, 10, 20)) -> DataFrame:
    """Patterns left by each least range of support."""
    ranges = steps.groupBy("pattern").agg((F.max("support") - F.min("support")).alias("range"))
    return ranges.select("pattern", "range", F.explode(F.array(*map(F.lit, deltas))).alias("delta")).groupBy("delta").agg(F.sum(F.when(F.col("range") >= F.col("delta"), 1).otherwise(0)).alias("patterns"))


def counts_below(tested: DataFrame, p: str = "p_value", bounds: tuple[float, ...] = (0.001, 0.005, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0)) -> DataFrame:
    """How many values lie below each bound."""
    return tested.select(p, F.explode(F.array(*map(F.lit, bounds))).alias("bound")).groupBy("bound").agg(F.sum(F.when(F.col(p) < F.col("bound"), 1).otherwise(0)).alias("n"))


def lowest(tested: DataFrame, p: str = "adjusted", most: int = 20) -> DataFrame:
    """The ``most`` tests of lowest p."""
    return tested.orderBy(p, "pattern", "event_id").limit(most)


def ranked_tests(tested: DataFrame, truth: DataFrame) -> DataFrame:
    """Adjusted values by both corrections and whether the truth has the pair."""
    known = truth.select("pattern", "event_id").distinct().withColumn("is_true", F.lit(True))
    both = benjamini_hochberg(tested)
    m = tested.agg(F.count("*").alias("m"))
    both = both.join(F.broadcast(m), F.lit(True)).withColumn("bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.col("m"))).drop("m")
    return both.join(known, ["pattern", "event_id"], "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))


def alpha_sweep(ranked: DataFrame, truth: DataFrame, alphas: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2, 0.5)) -> DataFrame:
    """True and false discoveries and rates for each alpha."""
    total = truth.select("pattern", "event_id").distinct().agg(F.count("*").alias("total"))
    rows = ranked.select("pattern", "event_id", "adjusted", "is_true", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    hit = F.col("adjusted") < F.col("alpha")
    pairs = rows.groupBy("alpha", "pattern", "event_id").agg(F.max(hit.cast("int")).alias("hit"), F.max(F.col("is_true").cast("int")).alias("known"))
    counts = pairs.groupBy("alpha").agg(F.sum(F.col("hit") * F.col("known")).alias("tp"), F.sum(F.col("hit") * (1 - F.col("known"))).alias("fp"))
    counts = counts.join(F.broadcast(total), F.lit(True)).withColumn("fn", F.col("total") - F.col("tp")).drop("total")
    return _rates(counts)


def histogram(tested: DataFrame, p: str = "p_value", bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1]; 1 falls in the last bin."""
    return tested.select(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def random_match(coupons: DataFrame, products: int) -> DataFrame:
    """By coupon size class of campaigns, the chance that one of two random items has a coupon."""
    sizes = coupons.groupBy("campaign").agg(F.count_distinct("item").alias("c"))
    kind = F.when(F.col("c") >= 3000, "A").when(F.col("c") >= 200, "B").otherwise("C")
    n, c = F.lit(float(products)), F.col("c")
    chance = 1 - (n - c) / n * ((n - c - 1) / (n - 1))
    return sizes.select("campaign", "c", kind.alias("kind"), chance.alias("chance")).groupBy("kind").agg(F.count("*").alias("campaigns"), F.avg("chance").alias("chance"))


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of each pattern's covered positions, common ones over all; patterns of one side alone have 0."""
    a, b = (merge(x.select("pattern", "s", "e"), "pattern") for x in (left, right))
    size = lambda x, name: x.groupBy("pattern").agg(F.sum(F.col("e") - F.col("s") + 1).alias(name))
    both = size(a, "na").join(size(b, "nb"), "pattern", "full").join(size(overlap(a, b, "pattern"), "nab"), "pattern", "left").na.fill(0)
    return both.select("pattern", (F.col("nab") / (F.col("na") + F.col("nb") - F.col("nab"))).alias("jaccard"))
