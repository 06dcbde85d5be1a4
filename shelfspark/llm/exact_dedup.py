"""Operator 10: exact dedup with counting quotient filters.

1. Each partition hashes its normalised texts (A-Z lower-cased) to 64 bits and sorts the hashes into counting quotient
   filters, one for each block of the hash range: a quotient's remainders stand sorted in one run, each with its count.
2. The filters of a block, one from each partition, merge without loss: equal (quotient, remainder) add their counts.
   Blocks hold about ``BLOCK_ROWS`` rows at any input size. A text that a third of all rows share is one entry of each filter.
3. Texts whose hash counts above one go to byte verification: they are grouped by hash and all their bytes. Partial
   aggregation collapses a task's copies before the shuffle, so hot groups stay small. All other texts are unique.
   Few repeated hashes are broadcast, and no text that is unique moves. Of too many, a bitmap of at most 2^``MOST_BITS`` bits
   is broadcast instead, by passes over shares of the hash range of ``PASS`` repeated hashes each: texts whose bit isn't set are
   unique and stay where they are. What is left is grouped and met with the repeated hashes exactly; of unique texts only those
   that share a bit with a repeated one move, n / 2^b of them with n hashes in b bits (at most 13 %, and 6 % below the bound).

Defined results: a null text counts as empty. The row with the largest doc_id of its group stays; a null doc_id is the
smallest; of rows that repeat both text and doc_id, one stays. An empty table gives an empty result; extra columns don't
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import BROADCAST_ROWS, cut, look_up, parts_of, quoted, sized, table

#: Rows to a block of the filter, about.
BLOCK_ROWS = 50_000

#: Bits of the bitmap at most (64 MB), and repeated hashes of a pass. There are 16 bits or more a hash below the bound.
MOST_BITS, PASS = 29, 1 << 26

#: Low bits of a hash that are its remainder; the bits above are block and quotient.
REMAINDER = 40


# Filters ---------------------------------------------------------------------------------------------------------


def build_filter(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counting quotient filter of uint64 hashes: occupied quotients, their run lengths, remainders and counts."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], np.ones(len(hashes), np.int64) if counts is None else counts[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    sums, hashes = np.add.reduceat(counts, first) if len(first) else counts[:0], hashes[first]
    quotients, runs = np.unique(hashes >> np.uint64(REMAINDER), return_counts=True)
    return quotients, runs.astype(np.uint32), hashes & np.uint64((1 << REMAINDER) - 1), sums


def hashes_of(parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    quotients, runs, remainders, _ = parts
    return (np.repeat(quotients, runs) << np.uint64(REMAINDER)) | remainders


def pack(parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    quotients, runs, remainders, counts = parts
    head = np.array([len(quotients), len(remainders)], np.uint64)
    return b"".join(x.tobytes() for x in (head, quotients, runs, remainders, counts.astype(np.int64)))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(data, np.uint64, 2))
    at, out = 16, []
    for kind, size in ((np.uint64, n), (np.uint32, n), (np.uint64, m), (np.int64, m)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return tuple(out)


def merge(filters: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The filter of all hashes of several filters. Each is a sorted run, and the stable sort merges runs."""
    return build_filter(np.concatenate([hashes_of(f) for f in filters]), np.concatenate([f[3] for f in filters]))


# Jobs ------------------------------------------------------------------------------------------------------------


def _normalised(x: bytes | None) -> bytes:
    return (x or b"").lower()  # of bytes: A-Z only


def fingerprints(df: DataFrame, id_col: str, text: str, keep_text: bool = False) -> DataFrame:
    """(id, fp, sha256) of each row, or (fp, norm) with the normalised text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts_of(batch, 1)):
            texts = [_normalised(x) for x in part.column(1).to_pylist()]
            fps = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64))
            if keep_text:
                yield pa.RecordBatch.from_arrays([fps, pa.array(texts, pa.binary())], ["fp", "norm"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), fps, pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], ["id", "fp", "sha"]
                )

    rows = df.select(quoted(id_col).alias("id"), quoted(text).cast("binary").alias("text"))
    light = StructType([rows.schema["id"], StructField("fp", LongType()), StructField("sha", BinaryType())])
    return rows.mapInArrow(run, "fp long, norm binary" if keep_text else light)


def repeated_fingerprints(light: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that count above one, by filters built in each partition and merged by block."""
    bits = max(0, (max(1, n_rows) // BLOCK_ROWS).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pending: list[np.ndarray] = []
        for batch in batches:
            pending.append(np.asarray(batch.column(0)).view(np.uint64))
            if sum(map(len, pending)) > 500_000:
                held = [merge([*held, build_filter(np.concatenate(pending))])]
                pending = []
        if pending:
            held = [merge([*held, build_filter(np.concatenate(pending))])]
        if not held:
            return
        hashes, counts = hashes_of(held[0]), held[0][3]
        block = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
        rows = [(int(block[a]), pack(build_filter(hashes[a:b], counts[a:b]))) for a, b in zip(starts, [*starts[1:], len(hashes)])]
        for at in range(0, len(rows), 500):
            blocks, filters = zip(*rows[at : at + 500])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(filters, pa.binary())], ["block", "filter"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        whole = merge([unpack(x) for x in group["filter"]])
        many = whole[3] > 1
        return pd.DataFrame({"fp": hashes_of(whole)[many].view(np.int64), "n": whole[3][many]})

    return light.select("fp").mapInArrow(build, "block long, filter binary").groupBy("block").applyInPandas(merged, "fp long, n long")


def maybe_repeated(texts: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """The rows (fp, ...) whose fp may be repeated, by broadcast bitmaps: all of those that are, few others. No row moves."""
    passes = -(-n_repeated // PASS) or 1
    bits = min(MOST_BITS, max(15, (16 * n_repeated // passes).bit_length()))
    own = lambda k: F.pmod(F.xxhash64(F.lit("pass"), "fp"), F.lit(passes)) == k
    place = F.xxhash64("fp").bitwiseAND((1 << bits) - 1)
    out = []
    for k in range(passes):
        held = repeated.where(own(k)).select(F.shiftright(place, 15).alias("block"), place.bitwiseAND(32767).alias("bit"))
        held = cut(held.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), 1 << 14)
        met = texts.where(own(k)).withColumns({"block": F.shiftright(place, 15), "bit": place.bitwiseAND(32767)}).join(F.broadcast(held), "block")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out.append(met.where(F.getbit(byte, F.col("bit").bitwiseAND(7).cast("int")) == 1).select(*texts.columns))
    return reduce(DataFrame.unionByName, out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    light = cut(fingerprints(docs, id_col, text).withColumn("row", F.monotonically_increasing_id()))
    n_rows = light.count()
    repeated = cut(repeated_fingerprints(light, n_rows))
    n_repeated = repeated.count()

    # Byte verification: one group for each different text among those whose fingerprints repeat.
    texts = fingerprints(docs, id_col, text, keep_text=True)
    if n_repeated <= most:
        texts = texts.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")
    else:
        texts = maybe_repeated(texts, repeated, n_repeated)
    groups = texts.groupBy("fp", "norm").agg(F.count("*").alias("group_size")).where("group_size > 1")
    groups = cut(
        groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size").join(
            sized(repeated.select("fp"), n_repeated, most), "fp", "left_semi"
        )
    )
    n_groups = groups.count()

    # The members of a group meet as partial maxima, one for each task and group; of equal ids the last row counts.
    members = light.join(sized(groups.select("fp", "sha"), n_groups, most), ["fp", "sha"], "left_semi")
    last = members.groupBy("fp", "sha").agg(F.max(F.struct("id", "row")).alias("last"))
    largest = cut(groups.join(sized(last, n_groups, most), ["fp", "sha"]).select(F.struct("fp", "sha").alias("text"), "last", "group_size"))
    known = look_up(light.withColumn("text", F.struct("fp", "sha")), largest, "text", n_groups, most)
    return known.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("last.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
