"""Writers of patterns, transactions and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def braces(pattern: Column) -> Column:
    return F.concat(F.lit("[{"), F.array_join(F.transform(pattern, lambda x: x.cast("string")), ", "), F.lit("}]"))


def pattern_rows(dense: DataFrame) -> DataFrame:
    """One row per pattern of two items or more, with its intervals as text, ordered by size (falling) and pattern."""
    rows = dense.where(F.size("pattern") >= 2).groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("("), x["s"].cast("string"), F.lit(","), x["e"].cast("string"), F.lit(")"))), ";")
    return rows.orderBy(F.desc(F.size("pattern")), "pattern").select(braces(F.col("pattern")).alias("pattern_components"), F.lit("[]").alias("pattern_gaps"), F.size("pattern").alias("pattern_size"), F.size("xs").alias("intervals_count"), text.alias("intervals"))


def write_patterns_csv(dense: DataFrame, path: str) -> None:
    """The same as one CSV file with a header."""
    pattern_rows(dense).coalesce(1).write.csv(path, header=True, mode="overwrite")


def interval_lines(dense: DataFrame) -> DataFrame:
    """``[1, 2] s e`` lines."""
    text = F.concat(F.lit("["), F.array_join(F.transform("pattern", lambda x: x.cast("string")), ", "), F.lit("]"))
    return dense.select(F.concat_ws(" ", text, F.col("s").cast("string"), F.col("e").cast("string")).alias("value"))


def transaction_lines(transactions: DataFrame) -> DataFrame:
    """``(t, value)``, the sorted items of a transaction set apart by blanks."""
    return transactions.select("t", F.array_join(F.transform(F.array_sort("items"), lambda x: x.cast("string")), " ").alias("value"))


def write_transactions(transactions: DataFrame, path: str) -> None:
    """One text file in the order of ``t``."""
    transaction_lines(transactions).repartition(1).sortWithinPartitions("t").select("value").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, digits: int = 4) -> None:
    """Rows as JSON, with doubles rounded."""
    rows.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes)).write.mode("overwrite").json(path)


def report(attributed: DataFrame) -> DataFrame:
    """Result lines for reading."""
    pattern = F.concat(F.lit("{"), F.array_join(F.transform("pattern", lambda x: x.cast("string")), ", "), F.lit("}"))
    return attributed.select(F.format_string("%s <- %s at %d (%s) score=%.4f p=%.4f adj_p=%.4f", pattern, F.col("event_name"), F.col("time"), F.col("direction"), F.col("score"), F.col("p_value"), F.col("adjusted")).alias("value"))


def attribution_rows(attributed: DataFrame) -> DataFrame:
    """The columns of the attributions file."""
    return attributed.select(
        F.array_join(F.transform("pattern", lambda x: x.cast("string")), " ").alias("pattern"), F.col("time").alias("change_time"), F.col("direction").alias("change_direction"), F.col("magnitude").alias("change_magnitude"),
        "event_name", "event_start", "event_end", "proximity", F.col("score").alias("attribution_score"), "p_value", F.col("adjusted").alias("adjusted_p_value"),
    )


def write_attributions_csv(attributed: DataFrame, path: str) -> None:
    """The same as a CSV folder."""
    attribution_rows(attributed).write.mode("overwrite").csv(path, header=True)
