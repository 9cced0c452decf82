"""Drivers of whole experiments (X3-X5, X9, X11): generate, mine, attribute, evaluate, sum up over seeds."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.operators import changes, dense, evaluation, support
from tideline.operators.itemsets import dense_itemsets
from tideline.operators.pipeline import Config, attribute, baseline
from tideline.operators.postings import timestamps
from tideline.sources import synthetic


def _mined(spark: SparkSession, scenario: synthetic.Scenario, config: Config, max_length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    occ = cut(synthetic.occurrences(spark, scenario).select("t", F.col("t").alias("basket_id"), "item"))
    return occ, cut(dense_itemsets(occ, config.window, config.theta, max_length)), synthetic.events(spark, scenario)


def _run(spark: SparkSession, name: str, scenario: synthetic.Scenario, config: Config, methods: Iterable[str], max_length: int) -> DataFrame:
    occ, found_dense, events = _mined(spark, scenario, config, max_length)
    truth, other = synthetic.ground_truth(spark, scenario, found_dense), synthetic.unrelated(spark, scenario)
    rows = []
    for method in methods:
        if method == "proposed":
            found = cut(attribute(found_dense, occ, events, scenario.n, config))
            scored = evaluation.intervals_and_events(found, truth, events)
        else:
            found = cut(baseline(method, found_dense, occ, events, scenario.n, config))
            scored = evaluation.patterns_and_events(found, truth, events)
        rate = evaluation.false_attribution(found, other).select(F.col("rate").alias("far"))
        rows.append(scored.join(rate, F.lit(True)).select(F.lit(name).alias("condition"), F.lit(scenario.seed).alias("seed"), F.lit(method).alias("method"), "tp", "fp", "fn", "precision", "recall", "f1", "far"))
    return cut(reduce(DataFrame.unionByName, rows))


def run(spark: SparkSession, scenarios: dict[str, list[synthetic.Scenario]], config: Config, methods: Iterable[str] = ("proposed",), max_length: int = 4) -> DataFrame:
    """A row for each condition, seed and method; sum up with ``evaluation.means`` and ``confidence``."""
    methods = list(methods)
    return reduce(DataFrame.unionByName, [_run(spark, name, s, config, methods, max_length) for name, own in scenarios.items() for s in own])


def null_run(spark: SparkSession, scenarios: list[synthetic.Scenario], config: Config, max_length: int = 2) -> DataFrame:
    """``(seed, n_predicted)`` of scenarios without effects, for ``evaluation.null_discoveries``."""
    rows = []
    for scenario in scenarios:
        occ, found_dense, events = _mined(spark, scenario, config, max_length)
        found = attribute(found_dense, occ, events, scenario.n, config)
        rows.append(cut(found.agg(F.count("*").alias("n_predicted")).select(F.lit(scenario.seed).alias("seed"), "n_predicted")))
    return reduce(DataFrame.unionByName, rows)


def semi_synthetic(occ: DataFrame, planted: list[synthetic.Planted], decoys: list[synthetic.Decoy], n: int, config: Config, seed: int = 0, max_length: int = 2) -> DataFrame:
    """Planted signals in real ``(t, item)``: mined, attributed, and evaluated by pattern and event."""
    spark = occ.sparkSession
    made = cut(synthetic.injected(occ, planted, seed).select("t", F.col("t").alias("basket_id"), "item"))
    scenario = synthetic.Scenario(n=n, planted=tuple(planted), decoys=tuple(decoys), seed=seed)
    events = synthetic.events(spark, scenario)
    found_dense = cut(dense_itemsets(made, config.window, config.theta, max_length))
    truth = spark.createDataFrame([(sorted(x.pattern), x.event_id) for x in planted], "pattern array<long>, event_id string")
    return evaluation.patterns_and_events(attribute(found_dense, made, events, n, config), truth, events)


def figure_series(spark: SparkSession, scenario: synthetic.Scenario, pattern: tuple[int, ...], window: int, theta: int) -> DataFrame:
    """X11: the layers of a figure of one pattern: ``(layer, t, end, value, label)``.

    ``support`` at every position, ``dense`` intervals, ``change`` points where
    the series crosses ``theta`` (their magnitudes, up or down), and ``event`` spans.
    """
    occ = cut(synthetic.occurrences(spark, scenario).select("t", F.col("t").alias("basket_id"), "item").where(F.col("item").isin(*pattern)))
    own = spark.createDataFrame([(sorted(pattern),)], "pattern array<long>")
    times = cut(timestamps(occ, own))
    none = F.lit(None)
    layers = [
        support.series(times, own, window, scenario.n).select(F.lit("support").alias("layer"), "t", none.cast("long").alias("end"), F.col("support").cast("double").alias("value"), F.lit("").alias("label")),
        dense.runs(times, window, theta).select(F.lit("dense").alias("layer"), F.col("s").alias("t"), F.col("e").alias("end"), F.lit(float(theta)).alias("value"), F.lit("").alias("label")),
        changes.threshold_crossings(times, own, window, scenario.n, theta).select(F.lit("change").alias("layer"), F.col("time").alias("t"), none.cast("long").alias("end"), F.col("magnitude").alias("value"), F.col("direction").alias("label")),
        synthetic.events(spark, scenario).select(F.lit("event").alias("layer"), F.col("start").alias("t"), "end", F.lit(0.0).alias("value"), F.col("name").alias("label")),
    ]
    return reduce(DataFrame.unionByName, layers)
