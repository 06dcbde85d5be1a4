"""A search index that is kept: postings of grams and words beside the prepared records.

An index is a folder of segments. A segment has the prepared records by source and locale, their postings (lists of the rows of
a gram or word, of a batch of records each) in buckets by hash, sorted, and the number of rows of each gram and word. ``append`` adds a segment of new records,
``merge`` makes one of all; both commit by a pointer (``sources.versions``), so a search reads one state throughout. A search
reads the buckets of the grams and words that its queries ask for, by partition, and within them the asked values by the sort.

Rows have numbers without gaps, in which a segment follows the one before. Records are not replaced: a record that is there
twice is found twice, and the search's own rule for equal URLs decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parts as looked
from ..functions.text import words_of
from ..shared import cut, remove, write_once
from ..sources import versions
from . import search as s

#: Partitions of the postings of a segment.
BUCKETS = 64

#: Asked values up to this number are written into the filter, which skips parts of files.
MOST_NAMED = 1000

PARTS = ("records", "grams", "words", "gram_counts", "word_counts")


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _numbered(rows: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Prepared rows with numbers without gaps from ``first`` on, and the next number. One count for each task goes to the driver."""
    local = F.col("_row")
    part = F.shiftright(local, 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("part")).count().collect())
    starts, at = [], first
    for number, n in counts:
        starts.append((number, at))
        at += n
    of = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    numbered = rows.withColumn("_part", part).join(of, "_part").withColumn("_row", F.col("_start") + local.bitwiseAND((1 << 33) - 1))
    return numbered.drop("_part", "_start"), at


def _write_lists(lists: DataFrame, column: str, path: str) -> None:
    """Lists of rows by bucket, sorted; those of a frequent value are dealt to several tasks by their first rows."""
    dealt = lists.repartition("bucket", F.pmod(F.xxhash64(F.get("rows", F.lit(0))), F.lit(8)))
    dealt.sortWithinPartitions("bucket", column).write.partitionBy("bucket").parquet(path)


def _write_postings(rows: DataFrame, folder: str, segment: str) -> None:
    scope = [c for c in s.SCOPE if c in rows.columns]
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in scope) + ", n int, rows array<long>"
    # Grams of one and two characters serve queries that have no longer part.
    grams = rows.select("_row", "hay", *scope).mapInArrow(lambda batches: looked.grams(batches, s.GRAM, scope), f"gram string{kept}")
    words = rows.select("_row", words_of(F.col("hay")).alias("words"), *scope).mapInArrow(lambda batches: looked.words(batches, scope), f"word string{kept}")
    for column, lists in (("gram", grams), ("word", words)):
        path = f"{folder}/{column}s/segment={segment}"
        _write_lists(lists.withColumn("bucket", _bucket(column)), column, path)
        counts = rows.sparkSession.read.parquet(path).groupBy(column).agg(F.sum("n").alias("n"))
        counts.write.parquet(f"{folder}/{column}_counts/segment={segment}")


def append(records: DataFrame, folder: str) -> int:
    """Add records to the index, which is made if it isn't there; the new version's number."""
    spark = records.sparkSession
    now = versions.current(spark, folder)
    number, state = now or (None, {"segments": [], "next_row": 0})
    segment = uuid.uuid4().hex
    prepared, path = write_once(s.prepared_columns(records))
    rows, next_row = _numbered(prepared, state["next_row"])
    rows.write.partitionBy(*(c for c in s.SCOPE if c in rows.columns)).parquet(f"{folder}/records/segment={segment}")
    _write_postings(rows, folder, segment)
    remove(spark, path)
    return versions.commit(spark, folder, {"segments": [*state["segments"], segment], "next_row": next_row}, number)


def merge(spark: SparkSession, folder: str) -> int:
    """One segment of all; what neither this nor the version before names is removed. The new version's number."""
    number, state = versions.current(spark, folder)
    segment = uuid.uuid4().hex
    for name in PARTS:
        rows = _read(spark, folder, name, state["segments"]).drop("segment")
        to = f"{folder}/{name}/segment={segment}"
        if name == "records":
            rows.write.partitionBy(*(c for c in s.SCOPE if c in rows.columns)).parquet(to)
        elif name.endswith("_counts"):
            column = name.removesuffix("_counts")
            rows.groupBy(column).agg(F.sum("n").alias("n")).write.parquet(to)
        else:
            _write_lists(rows, name.removesuffix("s"), to)
    done = versions.commit(spark, folder, {**state, "segments": [segment]}, number)
    live = {x for state in versions.forget(spark, folder) for x in state["segments"]}
    for name in PARTS:
        for there in versions.listed(spark, f"{folder}/{name}"):
            if there.startswith("segment=") and there.removeprefix("segment=") not in live:
                versions.delete(spark, f"{folder}/{name}/{there}")
    return done


def _read(spark: SparkSession, folder: str, name: str, segments: list[str]) -> DataFrame:
    paths = [f"{folder}/{name}/segment={x}" for x in segments]
    return spark.read.option("basePath", f"{folder}/{name}").option("recursiveFileLookup", "false").parquet(*paths)


class Stored(s.Scanned):
    """Postings that are read from an index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.segments = versions.current(spark, folder)[1]["segments"]
        self.rows = self._of("records")

    def _of(self, name: str) -> DataFrame:
        return _read(self.spark, self.folder, name, self.segments).drop("segment")

    def _asked(self, name: str, column: str, wanted: DataFrame) -> DataFrame:
        """The rows of the asked values. Buckets are few, so those asked for are named; values are, up to a number of them."""
        wanted = cut(wanted)
        buckets = [r[0] for r in wanted.select(_bucket(column)).distinct().collect()]
        named = [r[0] for r in wanted.limit(MOST_NAMED + 1).collect()]
        rows = self._of(name)
        if "bucket" in rows.columns:
            rows = rows.where(F.col("bucket").isin(buckets)).drop("bucket")
        if len(named) <= MOST_NAMED:
            return rows.where(F.col(column).isin(named))
        return rows.join(wanted, column, "left_semi")

    def _rows(self, name: str, column: str, wanted: DataFrame, *kept: str) -> DataFrame:
        """A row for each of the rows in the lists of the asked values."""
        return self._asked(name, column, wanted).select(column, *kept, F.posexplode("rows").alias("_at", "_row")).drop("_at")

    def grams(self, wanted: DataFrame) -> DataFrame:
        return self._rows("grams", "gram", wanted, *self._scope())

    def gram_counts(self, wanted: DataFrame) -> DataFrame:
        return self._asked("gram_counts", "gram", wanted).groupBy("gram").agg(F.sum("n").alias("n"))

    def words(self, wanted: DataFrame) -> DataFrame:
        return self._rows("words", "word", wanted)

    def vocabulary(self) -> DataFrame:
        return self._of("word_counts").select("word").distinct()

    def _scope(self) -> list[str]:
        return [c for c in s.SCOPE if c in self.rows.columns]


def open_index(spark: SparkSession, folder: str) -> Stored:
    """The state of an index that counts now."""
    return Stored(spark, folder)
