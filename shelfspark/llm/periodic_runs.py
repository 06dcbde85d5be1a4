"""Operator 11: runs of repeated words by string synchronising sets.

A run is a stretch of words with smallest period q, of at least ``max(LEAST, EXPONENT * q)`` words, that no neighbouring word
extends. All runs of each whole text are found, exactly, in three steps on the numbered words:

1. Highly periodic regions. Periods under ``1.5 * BASE`` are read off the places where a word equals the one p further on.
2. Synchronising sets at the scales t = ``BASE``, 2 ``BASE``, 4 ``BASE``, ... A window of t words is highly periodic if its
   period is at most t/3; the runs of smaller periods, all known by then, say which are. Every other window has the hash of its
   words as its number, and a place i is selected if the least number in [i, i + t] is that of i or of i + t. Selection depends
   on the next 2t words alone, so equal contexts of 2t words are selected alike, and t places in a row without a selected one
   lie in a highly periodic region.
3. Selected places of equal context at a distance q of 1.5 t to 3 t - 1 propose the period q. A run of three periods of q words
   holds such a pair: if none of its first 2q - 2t + 1 places were selected, 2q words of it had a period of t/3 and its
   smallest period were less than q. Equal contexts are over t/3 apart, as their windows are not highly periodic, so a place
   meets eight others at most. A proposal is extended by comparing words, and the smallest period of each stretch stays.

The texts of a part of a batch are one array with a different separator after each, so small texts cost no call each. Words
are numbered by a dictionary and hashes only propose, so results don't depend on hashes. Memory is that of a part of
``PART_BYTES`` or of one text; a text takes some 60 bytes a word.

Defined results: a null, empty or wordless text has no words and no runs, and collapses to the empty text. Repeated rows are
judged alike, and a null id is an id. An empty table gives an empty result; extra columns pass ``find_runs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import all_but, map_batches, parts_of, quoted, table

#: Least words of a run, and least words in periods.
LEAST, EXPONENT = 24, 3

#: Smallest scale of the synchronising sets.
BASE = 4

NONE = np.uint64(2**64 - 1)

RUNS = ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))


# Runs of an array ------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longer(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * size words from those of size words."""
    return _mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])


def _least_of(numbers: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` (a power of two) neighbours."""
    step = 1
    while step < size:
        numbers = np.minimum(numbers[:-step], numbers[step:])
        step *= 2
    return numbers


def short_periods(words: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches of three periods or more."""
    if len(words) < EXPONENT * period:
        return []
    same = np.diff(np.r_[False, words[:-period] == words[period:], False].astype(np.int8))
    starts, ends = np.flatnonzero(same == 1), np.flatnonzero(same == -1)
    long = ends - starts >= (EXPONENT - 1) * period
    return [(int(a), int(b) + period, period) for a, b in zip(starts[long], ends[long])]


def selected(hashes: np.ndarray, scale: int, runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The synchronising set of a scale among n words: ``hashes`` are those of windows of ``scale`` words."""
    periodic = [(a, b - scale) for a, b, q in runs if 3 * q <= scale <= b - a]
    if periodic:
        hashes = hashes.copy()
        for a, b in periodic:
            hashes[a : b + 1] = NONE
    places = n - 2 * scale + 1
    if places <= 0:
        return np.zeros(0, np.int64)
    first, last = hashes[:places], hashes[scale : scale + places]
    least = np.minimum(_least_of(hashes, scale)[:places], last)
    return np.flatnonzero((least != NONE) & ((least == first) | (least == last)))


def proposals(places: np.ndarray, contexts: np.ndarray, scale: int) -> np.ndarray:
    """Rows (period, place) of selected places of equal context whose distance is a period of this scale."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    out = []
    for step in range(1, 9):
        apart = places[step:] - places[:-step]
        fits = (contexts[step:] == contexts[:-step]) & (2 * apart >= 3 * scale) & (apart < 3 * scale)
        out.append(np.stack([apart[fits], places[:-step][fits]], 1))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _reach(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on are equal in turn, forwards or backwards."""
    n, size = 0, 64
    most = min(a, b) + 1 if step < 0 else len(words) - max(a, b)
    while n < most:
        size = min(size, most - n)
        x, y = (words[c - n - size + 1 : c - n + 1][::-1] if step < 0 else words[c + n : c + n + size] for c in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return n + int(differ[0])
        n, size = n + size, 2 * size
    return n


def all_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all maximal stretches of at least ``EXPONENT`` periods; ``longest`` bounds their ends'
    distance, as the longest text of several does."""
    n = len(words)
    longest = n if longest is None else longest
    best: dict[tuple[int, int], int] = {}
    for period in range(1, (3 * BASE + 1) // 2):
        for a, b, q in short_periods(words, period):
            best.setdefault((a, b), q)
    hashes, scale = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while scale < BASE and len(hashes) > scale:
        hashes, scale = _longer(hashes, scale), 2 * scale
    while 9 * scale <= 2 * longest:  # three periods of 1.5 * scale words
        contexts = _longer(hashes, scale)
        places = selected(hashes, scale, [(*k, q) for k, q in best.items()], n)
        last, end = 0, 0
        for q, i in proposals(places, contexts[places], scale).tolist():
            if q == last and i < end:
                continue
            a = i + 1 - _reach(words, i, i + q, -1)
            b = i + _reach(words, i, i + q, 1)
            last, end = q, b
            if b - a >= (EXPONENT - 1) * q:
                best.setdefault((a, b + q), q)  # periods ascend, so the smallest is there first
        hashes, scale = contexts, 2 * scale
    return [(a, b, q) for (a, b), q in best.items()]


# Texts -----------------------------------------------------------------------------------------------------------


def _of_part(texts: list[bytes | None]) -> Iterator[tuple[int, list[dict], bytes]]:
    """Of each text the number of words, the runs in order and the words without repetitions."""
    known: dict[bytes, int] = {}
    numbers = known.setdefault
    split = [(x or b"").split() for x in texts]
    each = [np.fromiter((numbers(w, len(known)) for w in words), np.int32, len(words)) for words in split]
    sizes = np.array([len(x) for x in each], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.full(int(sizes.sum()) + len(each), -1, np.int64)
    for k, (at, ids) in enumerate(zip(starts.tolist(), each)):
        whole[at : at + len(ids)] = ids
        whole[at + len(ids)] = len(known) + k  # a separator that equals nothing
    found: list[list[tuple[int, int, int]]] = [[] for _ in each]
    for a, b, q in sorted(all_runs(whole, int(sizes.max(initial=0)))):
        if b - a >= max(LEAST, EXPONENT * q):
            found[int(np.searchsorted(starts, a, "right")) - 1].append((a, b, q))
    for words, at, runs in zip(split, starts.tolist(), found):
        out = [{"start": a - at, "length": b - a, "period": q} for a, b, q in sorted(runs, key=lambda r: (r[0], r[2]))]
        kept = words
        if runs:
            keep = np.ones(len(words), bool)
            for a, b, q in runs:
                keep[a - at + q : b - at] = False
            kept = [words[i] for i in np.flatnonzero(keep).tolist()]
        yield len(words), out, b" ".join(kept)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for the text, and n_words, runs (start, length, period by start, then period) and collapsed:
    the words that no run repeats, joined by a space. Columns of ``docs`` with these names are replaced."""
    keep = all_but(docs, text, "n_words", "runs", "collapsed")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for part in (part for batch in batches for part in parts_of(batch, at)):
            counts, runs, left = zip(*_of_part(part.column(at).to_pylist()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield [
                *(part.column(i) for i in range(at)), pa.array(counts, pa.int32()), pa.array(runs, kind),
                pa.array(left, pa.binary()).cast(pa.string())
            ]

    rows = docs.select(*map(quoted, keep), quoted(text).cast("binary").alias("text"))
    return map_batches(rows, keep, run, n_words=IntegerType(), runs=RUNS, collapsed=StringType())


# The query -------------------------------------------------------------------------------------------------------


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text with the words from some place on repeating, for one id in ten; other texts and null ids are left alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")

    # The words are bound once, as the only element of an array.
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(""))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(bound, F.lit(0))).otherwise(text)


def greatest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first, then that of the smallest period."""
    size = lambda r: r["length"]
    better = lambda x, y: size(x) * y["period"] > size(y) * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    rows = find_runs(docs).withColumn("best", greatest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
