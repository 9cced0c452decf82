"""Readers of transactions, events and settings."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tideline.durable import ship

EVENTS = StructType([StructField("event_id", StringType()), StructField("name", StringType()), StructField("start", LongType()), StructField("end", LongType())])
TRUTH = "pattern array<long>, event_id string, interval_start long, interval_end long"
UNRELATED = "pattern array<long>, active_start long, active_end long, boost_factor double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(t, line)`` of one text file, trimmed; the last line end is no line.

    The file is read in splits, in parallel. A line's number is its place in its
    split and the number of lines in the splits before it, one row per split.
    """
    rows = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = rows.groupBy("split").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(before) - F.col("n")).drop("n")
    return rows.join(F.broadcast(splits), "split").select((F.col("ahead") + F.col("id") - F.col("first")).alias("t"), F.trim("value").alias("line"))


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))


def parse_baskets(line: Column) -> Column:
    """A line as baskets of items, set apart by `` | ``; none for an empty line. A word that is no number is an error."""
    return F.when(line == "", F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.split(line, r" \| "), _numbers))


def basket_text(spark: SparkSession, path: str) -> DataFrame:
    """``(t, baskets)``, a transaction per line."""
    return _lines(spark, path).select("t", parse_baskets(F.col("line")).alias("baskets"))


def flat_text(spark: SparkSession, path: str) -> DataFrame:
    """R2: ``(t, items)``, without baskets; a ``|`` is an error."""
    return _lines(spark, path).select("t", _numbers(F.col("line")).alias("items"))


def numbered_baskets(lines: DataFrame) -> DataFrame:
    """R1 for large inputs: ``(t, line)`` rows that carry their own number, in any number of files."""
    return lines.select(F.col("t").cast("long").alias("t"), parse_baskets(F.trim("line")).alias("baskets"))


def numbered_flat(lines: DataFrame) -> DataFrame:
    """R2 for large inputs: the same without baskets."""
    return lines.select(F.col("t").cast("long").alias("t"), _numbers(F.trim("line")).alias("items"))


def as_baskets(flat: DataFrame) -> DataFrame:
    """M5: flat transactions as ones of a single basket."""
    return flat.select("t", F.array("items").alias("baskets"))


def checked_events(rows: DataFrame) -> DataFrame:
    """Events with default names; a repeated id, or a start after the end, is an error."""
    rows = rows.select("event_id", F.coalesce("name", F.lit("")).alias("name"), "start", "end")
    twice = rows.groupBy("event_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"event_id {twice[0].event_id} is there twice")
    turned = rows.where(F.col("start") > F.col("end")).limit(1).collect()
    if turned:
        raise ValueError(f"event {turned[0].event_id} starts after it ends")
    return rows


def events_json(spark: SparkSession, path: str) -> DataFrame:
    """Events from a JSON array."""
    return checked_events(spark.read.json(path, schema=EVENTS, multiLine=True))


def truth_json(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth; intervals that aren't there are 0."""
    return spark.read.json(path, schema=TRUTH, multiLine=True).na.fill(0, ["interval_start", "interval_end"])


def unrelated_json(spark: SparkSession, path: str) -> DataFrame:
    """Patterns that no event is behind."""
    return spark.read.json(path, schema=UNRELATED, multiLine=True)


def settings(text: str) -> dict:
    """Settings from JSON text; the mining parameters must be there."""
    found = json.loads(text)
    for key in ("window_size", "min_support", "max_length"):
        if not isinstance(found.get("apriori_parameters", {}).get(key), int):
            raise ValueError(f"apriori_parameters.{key} must be a whole number")
    return found


def number_or(column: Column | str, default: int = -1) -> Column:
    """A trimmed number, or the default."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.trim(column.cast("string")).try_cast("bigint"), F.lit(default).cast("long"))


def csv(spark: SparkSession, path: str, columns: dict[str, int | str], schema: str | None = None) -> DataFrame:
    """Columns of a CSV file by header name or place, as strings."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.select(*(F.col(f"`{rows.columns[c] if isinstance(c, int) else c}`").alias(n) for n, c in columns.items()))


def workbook(spark: SparkSession, path: str, sheets: list[str], columns: list[str]) -> DataFrame:
    """The union of sheets of workbooks (.xlsx), their ``columns`` by header name, as strings.

    ``path`` may be a folder or pattern: each workbook is read by one task, row
    by row, since the rows of a compressed sheet have no other beginning. A cell
    that isn't there is null. Dates are the numbers that the file holds
    (:func:`serial_date`). A sheet or column that isn't there is an error.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch["content"].to_pylist():
                held: list[list[str | None]] = []
                for row in sheet_rows(io.BytesIO(body), sheets, columns):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], columns)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def serial_date(column: Column | str) -> Column:
    """The time of a workbook's date number: days since the end of 1899, rounded to seconds."""
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_seconds(F.round((column.cast("double") - 25_569) * 86_400)).cast("timestamp_ntz")


def sheet_rows(file, sheets: list[str], columns: list[str]) -> Iterator[list[str | None]]:
    """The cells of ``columns`` in each row below the header row of each of ``sheets``."""
    main, link = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    joined = lambda x: "".join(t.text or "" for t in x.iter(f"{main}t"))
    with zipfile.ZipFile(file) as archive:
        texts = [joined(x) for x in ElementTree.parse(archive.open("xl/sharedStrings.xml")).getroot()] if "xl/sharedStrings.xml" in archive.namelist() else []
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.parse(archive.open("xl/_rels/workbook.xml.rels")).getroot()}
        named = {x.get("name"): targets[x.get(link)] for x in ElementTree.parse(archive.open("xl/workbook.xml")).getroot().iter(f"{main}sheet")}
        for sheet in sheets:
            if sheet not in named:
                raise ValueError(f"no sheet {sheet}")
            where: list[str] | None = None
            with archive.open("xl/" + named[sheet].removeprefix("/xl/")) as body:
                for _, row in ElementTree.iterparse(body):
                    if row.tag != f"{main}row":
                        continue
                    cells = {}
                    for at, cell in enumerate(row):
                        value = cell.find(f"{main}v")
                        text = joined(cell) if cell.get("t") == "inlineStr" else None if value is None else texts[int(value.text)] if cell.get("t") == "s" else value.text
                        cells[re.sub(r"\d", "", cell.get("r")) if cell.get("r") else str(at)] = text
                    row.clear()
                    if where is None:
                        heads = {v: k for k, v in cells.items()}
                        if missing := [c for c in columns if c not in heads]:
                            raise ValueError(f"no column {missing[0]} in {sheet}")
                        where = [heads[c] for c in columns]
                    else:
                        yield [cells.get(k) for k in where]
