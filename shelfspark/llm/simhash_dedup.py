"""Operator 7: SimHash near-dedup with Golay-code fuzzy keys.

Equal fingerprints form a class. A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect Golay code
puts every 23-bit word within three bits of exactly one codeword; a segment is decoded to that codeword's index, and a
probe also to the codewords next to it, which are those that decode any word one bit away: one key where the segment lies
within two bits of its codeword, six keys otherwise. Up to three errors fall on the segments in one of two ways:

- a segment has none, and of the other two one has one at most: keys of that segment's bits and the other's codeword index,
- each has one: keys of the indices of the first two, and of a half of the third, of which one half has no error.

One side of the join has its decoded keys and the other its probes, so each link meets in a key of 30 to 35 bits, and the
join verifies the distance. In a key of more than ``CROWD`` fingerprints all are first held against the least one, and only
those that are still in different components against each other. Components are the fixed point of alternating star
contraction over the links between classes; each round is cut, so lost executors cost one.

Where a Jaccard similarity is asked for, fingerprints only propose. Links are then pairs of shingle sets of at least that
similarity, all of them: two such sets share one of their first shingles in any common order, so that the sets that share
one are compared. Shingles that a sample of texts shows to be common come last in the order. Two sets alone in a shingle are
a pair; of more, each is first held against one of them, and then only sets that are still in different components against
each other: within a shingle, components meet first, by the bounds of their members. That one is the least or, of more than
``CROWD``, the set whose own crowded shingles have the most sets: of many near copies the one with the fewest changes, which
links most of them. Three exact bounds drop pairs where they meet: sizes; what can still be shared after the place of the first
common shingle; and bitmaps of the sets' hashes, which can't differ in more bits than the sets in shingles. A pair whose first shingles already differ too much is dropped next, and
only the rest have their whole sets compared. Shingles of many sets are dealt to several tasks.

Defined results: a text without words (null, empty, white space) has fingerprint zero, linked like any other. Repeated
rows belong to one class. A null doc_id counts only where its component has no other. An empty table gives an empty result;
extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import BROADCAST_ROWS, cut, look_up, parts_of, quoted, settled, sized, table

SHINGLE, DISTANCE, SEED = 3, 3, 42

#: (shift, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))

#: Keys of an exact segment and a decoded one, and the (shift, bits) of the third segment's halves.
EXACT = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
HALVES = ((46, 9), (55, 9))

#: One text in so many is sampled for common shingles; those in so many sampled texts are common, up to a number of them.
#: They decide the order only, so any set of them gives the same links.
SAMPLED, COMMON, MOST_COMMON = 16, 5, 500_000

#: Keys with more members than this first join them to the least one.
CROWD = 40

#: Words of 64 bits of a set's bitmap, and members of a crowded shingle that a task holds against all others.
BITMAP, DEALT = 8, 1000
MAPS = [f"b{i}" for i in range(BITMAP)]

#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


# Fingerprints ----------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words, of the whole sequence if there are fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one, join = xxhash.xxh64_intdigest, b" ".join
    hashes = (one(join(x), SEED) for x in zip(*(words[i:] for i in range(size))))
    return np.fromiter(hashes, np.uint64, len(words) - size + 1) if len(words) >= size else np.array([one(join(words), SEED)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes. Counted in slices, so memory stays bounded."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate(values)))


def _of_texts(docs: DataFrame, id_col: str, text: str, each: Callable[[list[np.ndarray]], list[pa.Array]], size: int, **kinds) -> DataFrame:
    """id, and the columns ``kinds`` that ``each`` makes of some texts' shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1):
                made = each([shingle_hashes(x.as_py(), size) for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["id", *kinds])

    out = docs.select(quoted(id_col).alias("id"), quoted(text).cast("binary").alias("text"))
    return out.mapInArrow(run, StructType([out.schema["id"], *(StructField(name, kind) for name, kind in kinds.items())]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row."""
    return _of_texts(docs, id_col, text, lambda all_hashes: [_longs([simhash(h) for h in all_hashes])], size, fp=LongType())


# Golay keys ------------------------------------------------------------------------------------------------------


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words divided by the generator: the 11-bit syndrome."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of bytes at their three places; the error pattern of each syndrome."""
    places = np.stack([_remainder((np.arange(256) << s) & (2**23 - 1)) for s in (0, 8, 16)])
    bits = (1 << np.arange(23)).tolist()
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    patterns = np.array(patterns, np.int64)
    table = np.zeros(2048, np.int64)
    table[_remainder(patterns)] = patterns
    assert len(set(_remainder(patterns).tolist())) == 2048
    return places, table


def _syndrome(words: np.ndarray) -> np.ndarray:
    places = _golay()[0]
    return places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16]


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (the upper 12 bits) of the codeword within three bits of each 23-bit word."""
    return (words ^ _golay()[1][_syndrome(words)]) >> 11


def probes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and indices: for each word those of the codewords nearest to it and to the words one bit away."""
    around = np.sort(np.stack([nearest(words), *(nearest(words ^ (1 << b)) for b in range(23))], 1), 1)
    fresh = np.c_[np.ones(len(words), bool), around[:, 1:] != around[:, :-1]]
    return np.nonzero(fresh)[0], around[fresh]


def _bits(fps: np.ndarray, shift: int, n: int) -> np.ndarray:
    return ((fps >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)


def keys_of(fps: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Owners and keys: of each fingerprint its decoded keys, or its probes."""
    parts = [_bits(fps, s, n) for s, n in SEGMENTS]
    every = np.arange(len(fps))
    index = [probes(p) for p in parts] if probing else [(every, nearest(p)) for p in parts]
    owners, keys = [], []
    for case, (exact, near) in enumerate(EXACT):
        owner, decoded = index[near]
        owners.append(owner)
        keys.append(case << 48 | parts[exact][owner] << 12 | decoded)
    # All pairs of an index of the first segment and one of the second, of the same fingerprint.
    counts = np.bincount(index[1][0], minlength=len(fps))
    starts = np.cumsum(counts) - counts
    first, a = index[0]
    owner, a = np.repeat(first, counts[first]), np.repeat(a, counts[first])
    run = counts[first]
    b = index[1][1][np.repeat(starts[first], run) + np.arange(len(owner)) - np.repeat(np.cumsum(run) - run, run)]
    for case, (shift, n) in enumerate(HALVES, len(EXACT)):
        owners.append(owner)
        keys.append(case << 48 | a << 24 | b << 12 | _bits(fps, shift, n)[owner])
    return np.concatenate(owners), np.concatenate(keys)


def golay_keys(classes: DataFrame, probing: bool) -> DataFrame:
    """(key, fp): for each class its decoded keys, or its probe keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(every), 500):
                fps = every[at : at + 500]
                owners, keys = keys_of(fps, probing)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owners].view(np.int64))], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (key, part): rows of ``left`` under a key of over ``DEALT`` are dealt to several parts, and the right
    rows of the key go to each."""
    parts = cut(left.groupBy("key").agg((1 + F.floor(F.count("*") / DEALT)).cast("int").alias("parts")).where("parts > 1"))
    of = sized(parts, parts.count())
    known = lambda df: df.join(of, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return (
        known(left).withColumn("part", F.pmod(F.xxhash64("root_a"), F.col("parts")).cast("int")).drop("parts"),
        known(right).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"),
    )


def _across(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
    """Pairs of rows of (key, root_a, a) and (key, root_b, b) that share a key, differ in root and are ``near``. Roots meet first,
    so rows of one root, however many, are not paired; a root of a single row under a key has to be near to meet others."""
    group = lambda df, c: df.groupBy("key", "root_" + c).agg(F.when(F.count("*") == 1, F.min(c)).alias(c))
    roots, others = _dealt(cut(group(left, "a")), cut(group(right, "b")))
    met = roots.join(others, ["key", "part"]).where((F.col("root_a") != F.col("root_b")) & F.coalesce(near, F.lit(True)))
    return met.select("key", "root_a", "root_b").join(left, ["key", "root_a"]).join(right, ["key", "root_b"]).where(near)


def links(classes: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (a, b) of different fingerprints within three bits, whose components are those of all such pairs."""
    a, b = F.col("a"), F.col("b")
    near = (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)
    left, right = cut(golay_keys(classes, False).withColumnRenamed("fp", "a")), golay_keys(classes, True).withColumnRenamed("fp", "b")
    right = right.hint("merge")  # probes are many times the file that their size is guessed from, so they must not be broadcast
    crowded = cut(left.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("least")).where(F.col("n") > CROWD))
    n_crowded = crowded.count()
    if not n_crowded:
        return left.join(right, "key").where(near & (a < b)).select("a", "b")
    hint = lambda df: sized(df, n_crowded, most)
    few = cut(left.join(hint(crowded.select("key")), "key", "left_anti").join(right, "key").where(near & (a < b)).select("a", "b"))
    members = left.join(hint(crowded), "key"), cut(right.join(hint(crowded), "key"))
    stars = [m.select(F.col(c).alias("a"), F.col("least").alias("b")).where(near) for m, c in zip(members, "ab")]
    first = cut(few.unionByName(stars[0]).unionByName(stars[1]).distinct())
    roots = cut(components(first, most))
    n_roots = roots.count()
    rooted = [
        look_up(cut(m.select("key", F.col(c).alias("node"))), roots, "node", n_roots, most).select(
            "key", F.col("node").alias(c), F.coalesce("root", "node").alias("root_" + c)
        ) for m,
        c in zip(members, "ab")
    ]
    return first.unionByName(_across(*map(cut, rooted), near).select("a", "b"))


# Components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of ``edges`` (a, b).

    A large-star step links each node's larger neighbours to its smallest neighbour, a small-star step does so for the
    smaller ones; both keep components, and repeated in turn they end in stars. Minima are partially aggregated, and hot
    nodes are looked up by broadcast.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = edges.agg(F.count("*"), F.lit(None).cast("long")).first()
    while seen[0]:
        small = 2 * seen[0] <= most  # then all joins are broadcast, and nothing needs to be written in between
        held = (lambda df: df) if small else cut
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = held(both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("lo"), F.least("hi", "m").alias("m")))
        large = look_up(edges, least, "lo", 2 * seen[0], most).select("hi", F.col("m").alias("lo"))
        large = held(large.unionByName(least.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")).distinct())
        root = held(large.groupBy("hi").agg(F.min("lo").alias("m")))
        stars = look_up(large, root, "hi", 2 * seen[0], most).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
        edges = cut(stars.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct(), 4 * seen[0])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").bitwiseAND((1 << 40) - 1))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


# Verified similarity ---------------------------------------------------------------------------------------------


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _common(docs: DataFrame, id_col: str, text: str, size: int) -> np.ndarray:
    """Hashes of shingles in many of the sampled texts."""
    sample = docs.where(F.xxhash64(quoted(text)) % SAMPLED == 0)
    sets = _of_texts(
        sample, id_col, text, lambda all_hashes: [_lists([np.unique(h) for h in all_hashes])], size, keys=ArrayType(LongType())
    )
    counts = sets.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def first_shingles(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set, the first shingles in the common order: a set of at least ``similarity`` has one of its own first among them.
    A shingle is its place in the order: 62 bits of its hash, after those of all others if it is common."""
    late = np.zeros(len(found), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    places = np.sort((found >> np.uint64(2)) + (late.astype(np.uint64) << np.uint64(62)))
    return places[: len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1]


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each shingle of a set; it is set if an odd number of them shares it. What two sets have in common changes both
    bitmaps alike, so that these differ in the bits that an odd number of the other shingles has, however large the sets are."""
    counts = np.bincount(((found >> np.uint64(20)) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def shingle_sets(docs: DataFrame, id_col: str, text: str, size: int, similarity: float) -> DataFrame:
    """(id, fp, node, n, first, MAPS) of each row: the fingerprint; hash, size, first shingles and bitmap of the set of shingles."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text, size))  # at most MOST_COMMON hashes

    def each(all_hashes: list[np.ndarray]) -> list[pa.Array]:
        sets = [np.unique(h) for h in all_hashes]
        first = _lists([first_shingles(x, held.value, similarity) for x in sets])
        maps = np.stack([bitmap(x) for x in sets], 1)
        return [
            _longs([simhash(h) for h in all_hashes]), _longs([_node(x) for x in sets]), pa.array(list(map(len, sets)), pa.int32()), first,
            *map(_longs, maps)
        ]

    kinds = {"fp": LongType(), "node": LongType(), "n": IntegerType(), "first": ArrayType(LongType()), **dict.fromkeys(MAPS, LongType())}
    return _of_texts(docs, id_col, text, each, size, **kinds)


def _verified(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text: str, size: int, similarity: float, most: int
) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have the similarity. Only texts of pairs are read for their sets."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    n_wanted = wanted.count()
    ids = sized(classes.join(sized(wanted, n_wanted, most), "node").select(F.col("least").alias("of")).distinct(), n_wanted, most)

    def each(all_hashes: list[np.ndarray]) -> list[pa.Array]:
        sets = [np.unique(h) for h in all_hashes]
        return [_longs([_node(x) for x in sets]), _lists(sets)]

    texts = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("of")), "left_semi")
    sets = _of_texts(texts, "id", "text", each, size, node=LongType(), found=ArrayType(LongType()))
    sets = cut(sets.join(sized(wanted, n_wanted, most), "node", "left_semi").select("node", "found").dropDuplicates(["node"]))
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select(
        "a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes")
    )
    return joined.where(F.col("both") >= similarity * (F.col("sizes") - F.col("both")) - 1e-9).select("a", "b")


def _plausible(pairs: DataFrame, prints: DataFrame, similarity: float, most: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that may have the similarity by their sizes and first shingles: up to the place where
    the first of the two lists ends, what only one of them has counts against them."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    firsts = prints.select("node", "n", "first").join(sized(wanted, wanted.count(), most), "node", "left_semi")
    firsts = cut(firsts.dropDuplicates(["node"]))
    met = pairs.join(firsts.toDF("a", "m", "x"), "a").join(firsts.toDF("b", "n", "y"), "b")
    met = met.where(
        F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9
    ).withColumn("end", F.least(F.element_at("x", -1), F.element_at("y", -1)))
    upto = lambda c: F.size(F.filter(c, lambda v: v <= F.col("end")))
    apart = upto("x") + upto("y") - 2 * F.size(F.array_intersect("x", "y"))
    return met.where(apart <= (1 - similarity) / (1 + similarity) * (F.col("m") + F.col("n")) + 1e-9).select("a", "b")


def _centres(members: DataFrame, most: int) -> DataFrame:
    """(key, centre) of the keys of more than ``CROWD`` rows: of ``members`` (key, node, rows) the one whose such keys have the most rows."""
    crowd = cut(members.where(F.col("rows") > CROWD).select("key", "node", "rows").distinct())
    weights = cut(crowd.groupBy("node").agg(F.sum("rows").alias("weight")))
    return look_up(crowd, weights, "node", weights.count(), most).groupBy("key").agg(F.max(F.struct("weight", "node")).alias("of")).select(
        "key", F.col("of.node").alias("centre")
    )


def _alike(similarity: float, low: str = "n", high: str = "n") -> Column:
    """Whether sizes may have the similarity: n_a and n_b, or the least and greatest of some."""
    c = F.col
    return (c(high + "_a") >= similarity * c(low + "_b") - 1e-9) & (c(high + "_b") >= similarity * c(low + "_a") - 1e-9)


def _bitmaps_fit(similarity: float) -> Column:
    """Whether bitmaps differ in no more bits than sets of the similarity do in elements; unknown ones fit."""
    differ = sum((F.bit_count(F.col(m + "_a").bitwiseXOR(F.col(m + "_b"))) for m in MAPS[1:]), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
    return F.coalesce(differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9, F.lit(True))


def _places_fit(similarity: float, low: str = "n", high: str = "n") -> Column:
    """Whether enough can be shared from a shingle at places i_a and i_b on, as the first common one must allow."""
    c = F.col
    left = F.least(c(high + "_a") - c("i_a"), c(high + "_b") - c("i_b"))
    return left >= similarity / (1 + similarity) * (c(low + "_a") + c(low + "_b")) - 1e-9


def _apart(members: DataFrame, similarity: float) -> DataFrame:
    """(key, a, i_a, ..., b, i_b, ...) of the members of a key (key, i, a, root_a, n_a, the bitmap) in different components that may
    have the similarity. Components meet first, as one row with the bounds of its members, and with the bitmap of a single one."""
    own = members.withColumnRenamed("i", "i_a")
    one = F.count("*") == 1
    groups = own.groupBy("key", "root_a").agg(
        F.count("*").alias("members"), F.min("i_a").alias("i_a"), F.min("n_a").alias("low_a"), F.max("n_a").alias("high_a"),
        F.max("n_a").alias("n_a"), *(F.when(one, F.min(m + "_a")).alias(m + "_a") for m in MAPS)
    )
    groups = cut(groups)
    left, right = _dealt(groups.drop("members"), groups.drop("members"))
    swapped = lambda df: df.withColumnsRenamed({c: c[:-1] + "b" for c in df.columns if c.endswith("_a")} | {"a": "b"})
    may = _alike(similarity, "low", "high") & _places_fit(similarity, "low", "high") & _bitmaps_fit(similarity)
    met = left.join(swapped(right), ["key", "part"]).where((F.col("root_a") < F.col("root_b")) & may)
    pairs = met.select("key", "root_a", "root_b").join(own, ["key", "root_a"]).join(swapped(own), ["key", "root_b"])
    return pairs.where(_alike(similarity) & _places_fit(similarity) & _bitmaps_fit(similarity))


def similar_sets(
    docs: DataFrame, prints: DataFrame, classes: DataFrame, id_col: str, text: str, size: int, similarity: float, most: int
) -> DataFrame:
    """Edges (a, b) between nodes of ``prints`` whose components are those of all pairs of the similarity."""
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    verified = lambda pairs: settled(
        docs.sparkSession, lambda: _verified(pairs, docs, classes, id_col, text, size, similarity, most)
    )

    # Sets that fingerprints propose: of linked ones the least of each, and all of one fingerprint with its least.
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head")))
    n_heads = heads.count()
    head_of = lambda c: sized(heads.toDF(c, "head_" + c), n_heads, most)
    golay = links(heads.select("fp"), most).join(head_of("a"), "a").join(head_of("b"), "b").select(
        *ordered(F.col("head_a"), F.col("head_b"))
    )
    equal = look_up(
        prints.select("fp", "node"), heads, "fp", n_heads, most
    ).where("node != head").select(*ordered(F.col("node"), F.col("head")))

    # The first shingles of each set. Two sets are told apart by least and greatest, and their places are summed; rows that
    # repeat a set have no other, or count as more.
    keys = prints.select(F.posexplode("first").alias("i", "key"), "node")
    by_key = keys.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("node").alias("a"), F.max("node").alias("b"), F.sum("i").alias("places")
    )
    by_key = cut(by_key.where("a <> b"))
    crowded = by_key.where("rows > 2").select("key", F.col("a").alias("least"), "rows")
    members = cut(keys.join(sized(crowded, crowded.count(), most), "key").distinct())
    centres = cut(_centres(members, most))
    middle = F.coalesce("centre", "least")
    star = members.join(sized(centres, centres.count(), most), "key", "left").where(F.col("node") != middle).select(
        *ordered(F.col("node"), middle)
    )
    near = verified(_plausible(golay.unionByName(equal).unionByName(star).distinct(), prints, similarity, most))

    # Pairs that are not in one component yet.
    roots = cut(components(near, most).withColumnRenamed("root", "r"))
    n_roots, n_classes = roots.count(), classes.count()
    root_of = lambda df, c: look_up(
        df, roots.toDF(c, "root_" + c), c, n_roots, most
    ).withColumn("root_" + c, F.coalesce("root_" + c, c))
    size_of = lambda df, c: look_up(
        df, classes.select(F.col("node").alias(c), F.col("n").alias("n_" + c), *(F.col(m).alias(f"{m}_{c}") for m in MAPS)), c, n_classes, most // 8
    )
    apart = _apart(cut(size_of(cut(root_of(members.select("key", "i", F.col("node").alias("a")), "a")), "a")), similarity).select(
        *ordered(F.col("a"), F.col("b")), (F.col("i_a") + F.col("i_b")).alias("places")
    )
    two = by_key.where("rows = 2").groupBy("a", "b").agg(F.min("places").alias("places"))
    two = root_of(cut(root_of(cut(two), "a")), "b").where("root_a <> root_b").select(*apart.columns)
    shared = cut(two.unionByName(apart).groupBy("a", "b").agg(F.min("places").alias("places")))
    shared = size_of(cut(size_of(shared, "a")), "b").where(_alike(similarity) & _bitmaps_fit(similarity))
    # What comes before the first common shingle is in one of the sets only.
    enough = F.col("places") <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9
    return near.unionByName(verified(_plausible(shared.where(enough).select("a", "b"), prints, similarity, most)))


# Groups ----------------------------------------------------------------------------------------------------------


def _grouped(
    docs: DataFrame, prints: DataFrame, classes: DataFrame, id_col: str, text: str, size: int, similarity: float | None, most: int
) -> DataFrame:
    """(node, component_id, known) of the classes of more than one row or with links."""
    if similarity is None:
        edges = links(classes.select(F.col("node").alias("fp")), most)
    else:
        edges = similar_sets(docs, prints, classes, id_col, text, size, similarity, most)
    linked = cut(components(edges, most))
    rooted = cut(linked.join(sized(classes.select("node", "least"), classes.count(), most), "node"))
    smallest = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    joined = cut(look_up(rooted.select("node", "root"), smallest, "root", smallest.count(), most).select("node", "component_id"))
    known = look_up(classes.drop("n", *MAPS), joined, "node", joined.count(), most).where("rows > 1 or component_id is not null")
    return known.select("node", F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("known"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float | None = None,
    most: int = BROADCAST_ROWS
) -> DataFrame:
    """One row for each row of ``docs``: id, fp (long), component_id. Links are fingerprints within three bits, or with
    ``similarity`` all pairs of shingle sets with at least that Jaccard similarity."""
    if similarity is None:
        prints = cut(fingerprints(docs, id_col, text, size).withColumns({"node": F.col("fp"), "n": F.lit(None).cast("int")}))
    else:
        prints = cut(shingle_sets(docs, id_col, text, size, similarity))
    maps = [F.max(m).alias(m) for m in MAPS if m in prints.columns]
    classes = cut(prints.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.max("n").alias("n"), *maps))
    known = settled(docs.sparkSession, lambda: _grouped(docs, prints, classes, id_col, text, size, similarity, most))
    # A class of one row without links needs no look-up.
    found = look_up(prints.select("id", "fp", "node"), known, "node", known.count(), most)
    return found.select(
        F.col("id").alias(id_col), "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
