"""Cutting lineage so that a lost executor costs only its own tasks."""

from __future__ import annotations

import gc
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure the session has a checkpoint folder.

    ``spark.checkpoint.dir`` is taken from the session when the cluster names
    one. Only a local master may fall back on a temporary folder, since there
    the driver and the executors are one machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tideline-checkpoints-")
    context.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share."""
    checkpoint_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once, store it in the shared folder and read from there."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def temporary(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the application ends."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete what nothing will read again."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have the executors delete the shuffles of frames that nothing refers to any more, as those behind :func:`cut` and :func:`store`.

    Spark does so when the driver's JVM collects the frames, which with a large heap comes long after their use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffles deleted as soon as it ends; a later read of one of them would compute it again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_WORK: ContextVar[tuple[list[str], ...]] = ContextVar("tables", default=())


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths of all tables that are stored inside, for :func:`delete` once what was made of them is written."""
    held: list[str] = []
    token = _WORK.set((*_WORK.get(), held))
    try:
        yield held
    finally:
        _WORK.reset(token)


def store(frame: DataFrame, compression: str | None = None) -> DataFrame:
    """The same as :func:`cut` in columns: smaller where values repeat, for wide or large frames."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid4()}"
    temporary(frame.sparkSession, path)
    for held in _WORK.get():
        held.append(path)
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers may not have it installed; once per application."""
    context = spark.sparkContext
    if getattr(context, "_tideline_shipped", False):
        return
    here = Path(__file__).parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tideline-')}/tideline", "zip", here.parent, here.name)
    context.addPyFile(made)
    context._tideline_shipped = True
