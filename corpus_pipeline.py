"""From raw documents to training shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the
columns of ``documents``. A stage that begins deletes the tables that the stage
before it, which is written by then, has stored on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tideline.durable import delete, shared_folder, tables, temporary
from tideline.llm import binary, decontaminate, mixing, quality, simhash
from tideline.llm.catalog import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Equal stretches of the training order in which sequences are permuted; from one to the next the order of the curriculum holds.
PHASES = 64


#: Tables that stages have stored, by the stage and the application.
_STORED: dict[tuple[str, str], list[str]] = {}


def _after(before: str | None, stage: Stage) -> Stage:
    """The stage, which first deletes what the one ``before`` it has stored."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = spark.sparkContext.applicationId
        for path in _STORED.pop((own, before), ()):
            delete(spark, path)
        with tables() as held:
            out = stage(spark, docs, sf_dir)
        _STORED.setdefault((own, stage.__name__), []).extend(held)
        return out

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word that the repetition rule and the robust outlier test keep; short ones are judged by the test like any other."""
    return quality.keep_good(docs, min_words=1)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by five-word shingles: Jaccard similarity of 0.8 or more, or fingerprints within three bits."""
    return simhash.keep_one(docs, similar=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix uses them."""
    return mixing.training_order(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in their shards, which are written to the shared folder; the order of the files is that of the mix."""
    return binary.training_shards(docs, tokenizer("byte_bpe_50k.tiktoken"), uri=f"{shared_folder(spark)}/shards-{uuid4()}", phases=PHASES)


STAGES = [
    ("quality rules", _after(None, quality_rules)),
    ("near-dedup", _after("quality_rules", simhash_dedup)),
    ("decontamination", _after("simhash_dedup", decontamination)),
    ("mixing", _after("decontamination", mix_sources)),
    ("binary output", _after("mix_sources", token_shards)),
]
#: Robust estimates, fingerprints, alignments and tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them goes to the shared folder and is deleted once the next stage has read it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4()}"
    temporary(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            delete(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
