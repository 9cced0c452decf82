"""Retail data as transactions and events on the index axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.postings import dictionary, ordered_index, small
from tideline.durable import cut

#: Codes that are no products.
NO_PRODUCTS = ("POST", "D", "C2", "M", "BANK CHARGES", "PADS", "DOT", "CRUK", "AMAZONFEE", "S", "ADJUST", "B")


def clean(rows: DataFrame, country: str = "United Kingdom", excluded: tuple[str, ...] = NO_PRODUCTS) -> DataFrame:
    """Sales in one country: no cancellations, no fees, nothing without code or date, positive quantity and price; adds ``Date``."""
    rows = rows.where((F.col("Country") == country) & ~F.col("Invoice").cast("string").startswith("C"))
    rows = rows.withColumn("StockCode", F.trim(F.col("StockCode").cast("string"))).where(~F.col("StockCode").isin(*excluded))
    return rows.dropna(subset=["StockCode", "InvoiceDate"]).where("Quantity > 0 and Price > 0").withColumn("Date", F.to_date("InvoiceDate"))


def baskets(rows: DataFrame, order: list[str], code: str) -> DataFrame:
    """``(t, order..., codes)``: one transaction per group of ``order``, its distinct codes sorted."""
    groups = rows.groupBy(*order).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return ordered_index(groups, *order)


def receipts(rows: DataFrame) -> DataFrame:
    """One transaction per ``BASKET_ID``, in the order of its day and of the id as text."""
    groups = rows.groupBy(F.col("BASKET_ID").cast("string").alias("basket")).agg(F.max("DAY").alias("day"), F.array_sort(F.collect_set("PRODUCT_ID")).alias("codes"))
    return ordered_index(groups, "day", "basket")


def days(rows: DataFrame) -> DataFrame:
    """One transaction per day that has any, products sorted as text."""
    groups = rows.groupBy(F.col("DAY").alias("day")).agg(F.array_sort(F.collect_set(F.col("PRODUCT_ID").cast("string"))).alias("codes"))
    return ordered_index(groups, "day")


def encoded(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions with ``items`` numbered by the order of their codes, and the dictionary."""
    codes = cut(dictionary(transactions.select(F.explode("codes").alias("code")), "code"))
    long = transactions.select("t", F.explode("codes").alias("code")).join(small(codes), "code")
    items = long.groupBy("t").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return transactions.select("t").join(items, "t", "left").select("t", F.coalesce("items", F.array().cast("array<bigint>")).alias("items")), codes


def date_ranges(dated: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(event_id, start, end)``, the first and last ``t`` on dates within each range; ranges without any are dropped.

    ``dated``: ``(t, date)``, reduced to one row per date first.
    """
    per_date = dated.groupBy("date").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    met = ranges.join(per_date, (F.col("date") >= F.col("date_start")) & (F.col("date") <= F.col("date_end")))
    return met.groupBy("event_id").agg(F.min("first").alias("start"), F.max("last").alias("end"))


def day_ranges(dated: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same with days clamped to those there are: a missing first day moves on, a missing last day moves back."""
    per_day = dated.groupBy("day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = per_day.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    clamped = ranges.join(F.broadcast(ends), F.lit(True)).select("event_id", F.least(F.greatest("day_start", "low"), "high").alias("a"), F.least(F.greatest("day_end", "low"), "high").alias("b"))
    met = clamped.join(per_day, F.lit(True))
    found = met.groupBy("event_id").agg(F.min(F.when(F.col("day") >= F.col("a"), F.col("first"))).alias("start"), F.max(F.when(F.col("day") <= F.col("b"), F.col("last"))).alias("end"))
    return found.where(F.col("start") <= F.col("end"))


def campaign_names(campaigns: DataFrame) -> DataFrame:
    """Names as the description and a running number, in the order of ``pos``; sorted by start."""
    order = Window.partitionBy("description").orderBy("pos")
    return campaigns.withColumn("name", F.concat_ws("_", "description", F.row_number().over(order).cast("string"))).orderBy("start", "pos")


def metadata(transactions: DataFrame) -> DataFrame:
    """Counts, distinct items, and sizes of baskets ``(t, items)``."""
    size = F.size("items")
    sums = transactions.agg(F.count("*").alias("n_transactions"), F.round(F.avg(size), 2).alias("avg_size"), F.max(size).alias("max_size"), F.min(size).alias("min_size"))
    distinct = transactions.select(F.explode("items").alias("item")).distinct().agg(F.count("*").alias("n_items"))
    return sums.join(F.broadcast(distinct), F.lit(True))
