"""Column expressions and batch settings that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.durable import ship

#: White space is these six characters and nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """All words of a text in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words: a letter for each word and blank, less the blanks."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "x"), BLANKS, "")).cast("long")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(frame: DataFrame, *columns: str) -> list[Column]:
    """Two 64-bit hashes that name a row by content; equal rows share a key and are never null."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("second"), *reversed(columns)).alias("k2")]


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Make Python workers ready: bound the rows that reach one at once, as a text may be megabytes long, and send the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
