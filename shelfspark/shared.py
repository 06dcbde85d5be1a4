"""Rows that are written once to the folder that driver and executors share, and joins of counted sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may do without one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


#: Rows of a file where their number is known.
FILE_ROWS = 100_000

#: What was written within the innermost settled() that runs in this context; each thread has its own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def write_once(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read from there, and where it is."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if (within := _written.get()) is not None:
        within.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage: the rows are written once to the shared folder and read from there, column by column. If it is known
    that there are at most so many (narrow) rows, they go to few files."""
    return write_once(df if rows is None else df.coalesce(1 + rows // FILE_ROWS))[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete what write_once() wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """What is written within is deleted at the end, also after a failure."""
    mine: list[str] = []
    token = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(token)
        for path in mine:
            remove(spark, path)


def settled_at(spark: SparkSession, make: Callable[[], tuple[DataFrame, ...]]) -> list[tuple[DataFrame, str]]:
    """What ``make`` returns, each written once, and where; all that was written on the way is deleted, also if it fails."""
    outer = _written.get()
    with discarded(spark):
        rows = make()
        inner = _written.set(outer)  # the results outlast it
        try:
            return [write_once(df) for df in rows]
        finally:
            _written.reset(inner)


def settled_all(spark: SparkSession, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """As settled_at(), without the places."""
    return tuple(df for df, _ in settled_at(spark, make))


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """As settled_all(), of one DataFrame."""
    return settled_all(spark, lambda: (make(),))[0]


#: Rows that an application gives to Python at a time; texts are a few kB each.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def small_batches(spark: SparkSession) -> None:
    """For an application on executors of little memory: Arrow batches of some MB, unless its session has chosen a size. The
    operators themselves take batches of any size apart."""
    if BATCH_ROWS[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_ROWS)


def sized(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as the application has cores. Inputs of more parts stay as they are, without a shuffle: it is small
    ones in few row groups that would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
