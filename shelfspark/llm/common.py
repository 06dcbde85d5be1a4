"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..shared import cut, discarded, remove, settled, settled_at, write_once  # noqa: F401

#: ASCII white space, as a regular-expression class body, and its complement: a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker takes at a time from an Arrow batch (Spark bounds the batch itself).
PART_BYTES = 1 << 20

#: A side of a join is broadcast up to so many (narrow) rows, counted beforehand; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000

#: A key is hot if it has more than this share of the rows, so that there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= most else df


def look_up(left: DataFrame, right: DataFrame, key: str, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on the column ``key`` of both sides, where ``right`` has each key once, ``rows`` of them. A right side over
    the bound is joined by a shuffle, but for the hot keys of ``left``: these are few by their definition and are broadcast.
    Both sides must be read from files. Null keys meet nothing."""
    if rows <= most:
        return left.join(F.broadcast(right), key, "left")
    n = left.count()
    hot = cut(left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(HOT_ROWS, HOT_SHARE * n)).select(key))
    known = cut(right.join(F.broadcast(hot), key, "left_semi"))
    more = [c for c in right.columns if c != key]
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in more]
    return (
        left.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
        .unionByName(left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(known), key, "left"))
        .unionByName(left.where(F.col(key).isNull()).select("*", *nothing))
    )


def hash_sample(df: DataFrame, by: Column, rows: int, wanted: int) -> DataFrame:
    """About twice ``wanted`` of the counted ``rows``, those of smallest hash, or all: a sort of what is left stays small."""
    if rows <= 4 * wanted:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(1 << 40)) < int(2 * wanted / rows * (1 << 40)))


def columns_free_of(df: DataFrame, prefix: str) -> str:
    """A column prefix that no column of ``df`` starts with (names compare without case, as in Spark)."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_but(df: DataFrame, *names: str) -> list[str]:
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def map_batches(
    rows: DataFrame, keep: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], **more: DataType
) -> DataFrame:
    """The first columns of ``rows``, named ``keep``, and the columns ``more``; ``run`` gives the arrays of both. Python workers
    see columns by their places, so names may have any characters."""
    out = [*rows.schema.fields[: len(keep)], *(StructField(name, kind) for name, kind in more.items())]
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(out)])
    names = plain.names

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(arrays, plain).toDF(*keep, *more)


def parts_of(batch: pa.RecordBatch, at: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the text in column ``at``, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes) - 1).clip(0) // most
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield batch.slice(a, b - a)
