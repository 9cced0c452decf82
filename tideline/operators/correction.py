"""Corrections for many tests (C1, C2) and the cut after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.postings import small
from tideline.durable import cut


def benjamini_hochberg(tested: DataFrame, p: str = "p_value", *groups: str) -> DataFrame:
    """``adjusted``, within each of ``groups``.

    Equal values of p share a rank, the highest among them. The distinct values
    are range-partitioned and ordered within their partitions; counts and
    minima of whole partitions, a row for each partition and group, give the rest.
    """
    keys = list(groups)
    counts = tested.groupBy(*keys, p).agg(F.count("*").alias("__n"))
    placed = cut(counts.repartitionByRange(*keys, p).withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part", *keys)
    placed = placed.withColumn("__rank", F.sum("__n").over(local.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = placed.groupBy("__part", *keys).agg(F.sum("__n").alias("__size"))
    order = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = cut(parts.withColumns({"__ahead": F.sum("__size").over(order) - F.col("__size"), "__m": F.sum("__size").over(Window.partitionBy(*keys))}))
    value = F.least(F.lit(1.0), F.col(p) * F.col("__m") / (F.col("__rank") + F.col("__ahead")))
    ranked = placed.join(small(parts), ["__part", *keys]).withColumn("__v", value)
    ranked = cut(ranked.withColumn("__least", F.min("__v").over(local.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    later = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.groupBy("__part", *keys).agg(F.min("__v").alias("__v")).withColumn("__after", F.min("__v").over(later)).drop("__v")
    ranked = ranked.join(small(cut(after)), ["__part", *keys]).select(*keys, p, F.least("__least", F.coalesce("__after", F.lit(1.0))).alias("adjusted"))
    return tested.join(small(cut(ranked)), [*keys, p])


def bonferroni(tested: DataFrame, p: str = "p_value", *groups: str) -> DataFrame:
    """P times the number of tests, 1 at most."""
    totals = tested.groupBy(*groups).agg(F.count("*").alias("__m"))
    joined = tested.join(small(cut(totals)), list(groups)) if groups else tested.join(F.broadcast(totals), F.lit(True))
    return joined.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("__m"))).drop("__m")


def corrected(tested: DataFrame, method: str = "bh", p: str = "p_value", *groups: str) -> DataFrame:
    if method == "bh":
        return benjamini_hochberg(tested, p, *groups)
    if method == "bonferroni":
        return bonferroni(tested, p, *groups)
    raise ValueError(f"no correction {method}")


def significant(tested: DataFrame, alpha: float) -> DataFrame:
    """strictly below ``alpha``."""
    return tested.where(F.col("adjusted") < alpha)
