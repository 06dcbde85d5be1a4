"""Operator 12: near duplicates among vectors by spherical-cap filters.

1. Equal vectors form a class; only vectors whose hashes repeat are compared for that, and only their rows move.
2. Filters are the codewords of random product codes: a random rotation cuts the space into blocks, and a filter's direction has
   one of some random unit vectors in each block. A vector is list-decoded to all filters of inner product ``alpha`` or more:
   block by block, prefixes that the best of the blocks left can't lift to alpha are dropped. ``plan_for`` chooses alpha by the
   number of vectors, so that a filter catches ``LOAD`` unrelated ones on average, the length of a code so that it catches a
   vector ``CAUGHT`` times, and adds codes until of ``TRIED`` random pairs at the asked cosine all but a share of ``MISSED``
   share a filter. By the random rotations that holds for any vectors.
3. In a filter of more than ``CROWD`` vectors all are held against the least one, the pivot. Those within half the asked angle of
   a pivot form its ball; all pairs of a ball are links by the triangle inequality and are counted, not listed. A ball and
   every other vector are units.
4. Units that share a filter meet once. Two vectors are verified in double precision. A ball meets a unit with its pivot first:
   if no member can be near enough the pair goes, else the members are verified one by one.
5. Links and the balls' stars lead to components by star contraction.

Pairs that share no filter are missed: about ``MISSED`` of those at exactly the asked cosine and far fewer above; the tests measure
it against brute force. All vectors are indexed, and no filter, ball or pair is capped. Work beyond the input's
size is that of the links themselves where they lie outside of balls.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors link only
with vectors of the same length. Repeated rows are links of each other. A null id counts only where its component has no other,
and is kept only there. An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, look_up, quoted, settled, sized, table
from .simhash_dedup import components

COSINE = 0.9

#: Unrelated vectors that a filter catches on average, filters of a code that catch a vector, vectors of a code's block at most.
LOAD, CAUGHT, MOST_WORDS = 1 / 8, 0.4, 600

#: The share of pairs at the asked cosine that may be missed, and the random pairs that it is measured on.
MISSED, TRIED, SEED = 0.002, 1500, 12

#: Filters with more vectors than this get a pivot.
CROWD = 40

#: Bytes of vectors that are broadcast.
VECTOR_BYTES = 16 << 20

#: Room for rounding where links follow without being computed.
ROOM = 1e-6


# Filters ---------------------------------------------------------------------------------------------------------


class Plan(NamedTuple):
    size: int  # of the space
    alpha: float
    words: int  # vectors of a block
    blocks: int
    codes: int


@cache
def _caps(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights from -1 to 1, and the share of the sphere at each height or above."""
    angles = np.linspace(0, np.pi, 20_001)
    density = np.sin(angles) ** (size - 2)
    below = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return np.cos(angles)[::-1], (below / below[-1])[::-1]


def cap(height: np.ndarray, size: int) -> np.ndarray:
    heights, shares = _caps(size)
    return np.interp(height, heights, shares)


def at_cosine(rng: np.random.Generator, x: np.ndarray, cosine: float) -> np.ndarray:
    """Random unit vectors at this cosine to the given ones."""
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(-1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=-1, keepdims=True)


def sharing(x: np.ndarray, y: np.ndarray, plan: Plan) -> Iterator[np.ndarray]:
    """Which pairs of unit vectors share a filter of each code."""
    for number in range(plan.codes):
        a, b = (owners * plan.words**plan.blocks + words for owners, words in (decoded(v, plan, number) for v in (x, y)))
        yield np.unique(np.intersect1d(a, b) // plan.words**plan.blocks)


@cache
def plan_for(length: int, n: int, cosine: float) -> Plan:
    """The plan for about n vectors of a length."""
    size = max(4, length)
    n = 1 << max(n, 1).bit_length()
    grid = np.linspace(0.05, 0.7, 131)
    fits = np.flatnonzero(n * cap(grid, size) <= LOAD)
    alpha = float(grid[fits[0]] if len(fits) else grid[-1])
    wanted = CAUGHT / float(cap(alpha, size))
    blocks = next(m for m in range(1, size) if wanted ** (1 / m) <= MOST_WORDS or m == size // 4)
    plan = Plan(size, alpha, max(2, round(wanted ** (1 / blocks))), blocks, 1 << 12)
    rng = np.random.default_rng([SEED, length])
    x = rng.standard_normal((TRIED, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = np.zeros(TRIED, bool)
    for codes, some in enumerate(sharing(x, at_cosine(rng, x, cosine), plan), 1):
        found[some] = True
        if (~found).mean() <= MISSED:
            break
    return plan._replace(codes=codes)


@lru_cache(1 << 10)
def _code(plan: Plan, number: int) -> list[np.ndarray]:
    """Of each block the matrix that takes a vector to its inner products with the block's vectors."""
    rng = np.random.default_rng([SEED, number, plan.size])
    rotation = np.linalg.qr(rng.standard_normal((plan.size, plan.size)))[0]
    out = []
    for part in np.array_split(np.arange(plan.size), plan.blocks):
        words = rng.standard_normal((len(part), plan.words))
        out.append(rotation[:, part] @ (words / np.linalg.norm(words, axis=0)) / np.sqrt(plan.blocks))
    return out


def decoded(units: np.ndarray, plan: Plan, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and numbers of all codewords whose inner product with a unit vector is alpha or more."""
    products = [units @ m for m in _code(plan, number)]
    best = np.stack([p.max(1) for p in products], 1)
    left = best[:, ::-1].cumsum(1)[:, ::-1] - best  # what the blocks after each can add
    others = best.sum(1, keepdims=True) - best
    owners, sums, words = np.arange(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
    for block, p in enumerate(products):
        of, word = np.nonzero(p >= plan.alpha - others[:, block, None])
        counts = np.bincount(of, minlength=len(units))
        starts, each = np.cumsum(counts) - counts, counts[owners]
        at = np.repeat(starts[owners] - np.cumsum(each) + each, each) + np.arange(each.sum())
        owners = np.repeat(owners, each)
        sums, words = np.repeat(sums, each) + p[owners, word[at]], np.repeat(words, each) * plan.words + word[at]
        kept = sums + left[owners, block] >= plan.alpha
        owners, sums, words = owners[kept], sums[kept], words[kept]
    return owners, words


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the rows and their vectors as doubles, scaled by a power of two (which is exact) against overflow."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        yield rows, np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def caught(vectors: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(filter, node) of each vector's filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for rows, x in matrices(part.column(1)):
                    length, plan = x.shape[1], plans[x.shape[1]]
                    units = np.zeros((len(x), plan.size))
                    units[:, :length] = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for number in range(plan.codes):
                        owners, words = decoded(units, plan, number)
                        # Upper bits tell codes and lengths apart; a clash only costs a comparison.
                        filters = words ^ ((length * plan.codes + number) % (1 << 15) << 48)
                        yield pa.RecordBatch.from_arrays([pa.array(filters), pa.array(nodes[at + rows[owners]])], ["filter", "node"])

    return vectors.select("node", "vec").mapInArrow(run, "filter long, node long")


# Classes ---------------------------------------------------------------------------------------------------------


def _classes(rows: DataFrame, most: int, most_vectors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (row, id, vec, hash) rows with usable vectors: (row, node) of the rows of repeated vectors, where the node is the row
    of the least id; (node, copies) of their classes; and (node, vec) of all classes."""
    hashes = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    hashes = cut(hashes)
    again = cut(rows.join(sized(hashes, hashes.count(), most), "hash", "left_semi").withColumn("key", F.struct("hash", "vec")))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    groups = cut(again.groupBy("key").agg(first.alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    n_groups = groups.count()
    members = look_up(again, groups, "key", n_groups, most_vectors).where("copies is not null")
    members = cut(members.select("row", F.col("first.row").alias("node")))
    other = members.where("row <> node").select("row")
    nodes = rows.join(sized(other, members.count(), most), "row", "left_anti").select(F.col("row").alias("node"), "vec")
    return members, groups.select(F.col("first.row").alias("node"), "copies"), nodes


# Links -----------------------------------------------------------------------------------------------------------


def with_cosine(pairs: DataFrame, vectors: DataFrame, n: int, most_vectors: int) -> DataFrame:
    """Pairs (a, b) and the cosine of their vectors, null if they differ in length."""
    side = lambda c, v: vectors.select(F.col("node").alias(c), F.col("vec").alias(v))
    met = look_up(cut(look_up(cut(pairs.select("a", "b")), side("a", "x"), "a", n, most_vectors)), side("b", "y"), "b", n, most_vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                out = np.full(part.num_rows, np.nan)
                others = {y.shape[1]: (rows, y) for rows, y in matrices(part.column(3))}
                for rows, x in matrices(part.column(2)):
                    theirs, y = others.get(x.shape[1], (rows[:0], x[:0]))
                    both, i, j = np.intersect1d(rows, theirs, return_indices=True)
                    x, y = x[i], y[j]
                    dots = [np.einsum("ij,ij->i", u, v) for u, v in ((x, y), (x, x), (y, y))]
                    out[both] = dots[0] / (np.sqrt(dots[1]) * np.sqrt(dots[2]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, from_pandas=True)], ["a", "b", "cosine"])

    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cosine double")


def _units(caught_rows: DataFrame, vectors: DataFrame, n: int, cosine: float, most: int, most_vectors: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(node, ball) of the vectors in balls, the crowded filters, and what both count."""
    crowded = cut(caught_rows.groupBy("filter").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where(F.col("n") > CROWD))
    n_crowded = crowded.count()
    stars = caught_rows.join(sized(crowded.select("filter", "pivot"), n_crowded, most), "filter").where("node <> pivot")
    stars = with_cosine(stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), vectors, n, most_vectors)
    near = stars.where(F.col("cosine") >= np.sqrt((1 + cosine) / 2) + ROOM)
    balls = cut(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("ball")))
    pivots = balls.select(F.col("ball").alias("node")).distinct().join(balls, "node", "left_anti").select("node", F.col("node").alias("ball"))
    return cut(balls.unionByName(pivots)), crowded.select("filter"), n_crowded


def _linked(
    vectors: DataFrame, copies: DataFrame, ids: DataFrame, n: int, plans: dict[int, Plan], cosine: float, most: int, most_vectors: int
) -> DataFrame:
    """(node, others, component_id) of the classes with links to others."""
    filters = cut(caught(vectors, plans))
    balls, crowded, n_crowded = _units(filters, vectors, n, cosine, most, most_vectors)
    n_balls = balls.count()

    # Units that share a filter; in crowded ones the rows of a ball are one.
    unit = lambda rows: look_up(rows, balls, "node", n_balls, most).select("filter", F.coalesce("ball", "node").alias("unit"))
    hint = sized(crowded, n_crowded, most)
    few = unit(cut(filters.join(hint, "filter", "left_anti")) if n_balls > most else filters.join(hint, "filter", "left_anti"))
    many = unit(cut(filters.join(hint, "filter", "left_semi"))).distinct()
    dealt = few.unionByName(many)
    met = dealt.withColumnRenamed("unit", "a").join(dealt.withColumnRenamed("unit", "b"), "filter").where("a < b").select("a", "b").distinct()
    near = cut(with_cosine(met, vectors, n, most_vectors))

    # Two vectors are linked or not; a ball reaches half the angle further.
    angle = float(np.arccos(cosine))
    pivots = cut(balls.select(F.col("ball").alias("c")).distinct())
    is_ball = lambda rows, c: rows.join(
        sized(pivots.select(F.col("c").alias(c), F.lit(1).alias("ball_" + c)), n_balls, most), c, "left"
    )
    known = is_ball(is_ball(near.where("cosine is not null"), "a"), "b").withColumn(
        "radius", (F.coalesce("ball_a", F.lit(0)) + F.coalesce("ball_b", F.lit(0))) * angle / 2
    )
    singles = known.where((F.col("radius") == 0) & (F.col("cosine") >= cosine)).select("a", "b")
    reach = known.where((F.col("radius") > 0) & (F.acos(F.least(F.col("cosine"), F.lit(1.0))) <= angle + F.col("radius") + ROOM)).select("a", "b")
    inside = lambda rows, c: rows.join(
        sized(balls.select(F.col("ball").alias(c), F.col("node").alias("in_" + c)), n_balls, most), c, "left"
    ).withColumn(c, F.coalesce("in_" + c, c)).drop("in_" + c)
    members = with_cosine(inside(inside(cut(reach), "a"), "b"), vectors, n, most_vectors).where(F.col("cosine") >= cosine)
    links = cut(singles.unionByName(members.select("a", "b")))

    # How many others each is linked with, copies counted.
    n_copies = copies.count()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("of"), F.col("b").alias("node"))
    weight = lambda rows: rows.join(sized(copies, n_copies, most), "node", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    listed = weight(both).groupBy(F.col("of").alias("node")).agg(F.sum("copies").alias("others"))
    of_ball = cut(weight(balls).groupBy("ball").agg(F.sum("copies").alias("inside")))
    counted = weight(cut(look_up(balls.select("node", "ball"), of_ball, "ball", of_ball.count(), most)))
    counted = counted.select("node", (F.col("inside") - F.col("copies")).alias("others"))
    others = cut(listed.unionByName(counted).groupBy("node").agg(F.sum("others").alias("others")))

    roots = cut(components(links.unionByName(balls.select(F.col("node").alias("a"), F.col("ball").alias("b"))), most))
    n_roots = roots.count()
    named = cut(ids.join(sized(roots, n_roots, most), "node"))
    least = cut(named.groupBy("root").agg(F.min("id").alias("component_id")))
    found = look_up(cut(named.drop("id").join(sized(others, n_roots, most), "node")), least, "root", least.count(), most)
    return found.select("node", "others", "component_id")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cosine: float = COSINE, most: int = BROADCAST_ROWS
) -> DataFrame:
    """One row for each row: the id, n_links (other rows linked directly), component_id (the least id that links reach) and kept."""
    spark, v = rows.sparkSession, F.col("vec")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    every = cut(
        rows.select(quoted(id_col).alias("id"), quoted(vec).alias("vec")).withColumns(
            {"row": F.monotonically_increasing_id(), "hash": F.xxhash64("vec"), "usable": F.coalesce(usable, F.lit(False))}
        )
    )
    good = every.where("usable").select("row", "id", "vec", "hash")
    lengths = {r[0]: r[1] for r in good.groupBy(F.size("vec")).count().collect()}  # one row for each length
    plans = {length: plan_for(length, n, cosine) for length, n in lengths.items()}
    n, most_vectors = sum(lengths.values()), VECTOR_BYTES // (8 * max(lengths, default=1))
    members, copies, nodes = _classes(good, most, most_vectors)
    linked = settled(
        spark, lambda: _linked(nodes, copies, good.select(F.col("row").alias("node"), "id"), n, plans, cosine, most, most_vectors)
    )
    n_members, n_copies, n_linked = members.count(), copies.count(), linked.count()
    named = cut(look_up(every.select("id", "row"), members, "row", n_members, most).withColumn("node", F.coalesce("node", "row")))
    least = good.select(F.col("row").alias("node"), F.col("id").alias("own")).join(sized(copies, n_copies, most), "node")
    found = look_up(cut(look_up(named, cut(least), "node", n_copies, most)), linked, "node", n_linked, most)
    component = F.when(F.col("others").isNotNull(), F.col("component_id")).when(F.col("copies").isNotNull(), F.col("own")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (
    SELECT vec_id, e FROM v
    WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.a = v.vec_id LEFT JOIN counted c ON c.a = v.vec_id
"""
