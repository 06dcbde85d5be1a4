"""Operator 6: mixing sources to target weights.

Every document gets a random key, a hash of its id and text. Within a source the keys are range-partitioned into equal
ranges, as many as the source's rows need (``RANGE_ROWS`` each); a range is sorted in one task, and the prefix sums of the
ranges' totals, by ``RANGES`` of them and then within, give every document the number of words before it in its source.
A source's budget is a number of full epochs and a rest; the rest is cut out of the key order at the exact word. No range,
whatever the source's share, grows with the input. The table of sources, one row each, is ordered in one task.

Defined results: a null text has size 0; a null source is a source of its own and comes last. Ids may repeat or be null;
rows that repeat id and text take adjacent places in the order. Reruns agree, as keys depend on ids and texts alone. If all
sizes are 0, so are targets and words taken. An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from .common import BROADCAST_ROWS, WORD, cut, quoted, sized, table

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS, SEED = 1.5, 2.0, 17
RANGE_ROWS, RANGES = 4_000, 1_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, rows) with weight and target: ``share`` of all words by weight, none above ``most`` times its
    size. Resharing the excess until none is above ends at a level L with target = min(most * size, L * weight); the
    sources that stop are those of least ``size / weight``, so running sums in that order give L."""
    everything = w.Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = w.Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before, whole = by_fill.rowsBetween(w.Window.unboundedPreceding, -1), by_fill.rowsBetween(
        w.Window.unboundedPreceding, w.Window.unboundedFollowing
    )
    leveled = (
        sizes.withColumn("place", F.row_number().over(everything) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn(
            "level",
            (
                share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
            ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        )
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    )
    # The level of the first source that doesn't fill up holds for all after it.
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    return leveled.withColumn(
        "target", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap")))
    ).select("source", "source_size", "rows", "weight", "target")


def mix(
    docs: DataFrame, size: Column, id_col: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, whole: bool = False, seed: int = SEED, key: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, size, source, source_size, target, taken. With ``whole`` the document at the
    cut is taken whole if more than half of it is within the budget, and not at all otherwise. ``key`` stands for the id in
    the random order."""
    order = F.xxhash64(F.lit(seed), quoted(id_col) if key is None else key, quoted(text)).bitwiseAND((1 << 62) - 1)
    keyed = cut(
        docs.select(quoted(id_col).alias("id"), quoted(source).alias("source"), size.cast("long").alias("size"), order.alias("key"))
    )
    shares = cut(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, share, most))
    shares = shares.withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("long"))
    n_sources = shares.count()
    same = F.col("k.source").eqNullSafe(F.col("s.source"))
    placed = keyed.alias("k").join(sized(shares.alias("s"), n_sources, BROADCAST_ROWS), same).select(
        "k.*", "source_size", "target", F.floor(F.col("key") / (1 << 62) * F.col("ranges")).alias("range")
    )

    sums = placed.groupBy(
        F.col("source").alias("of"), F.col("range").alias("at")
    ).agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("at") / RANGES))
    upto = lambda by, *of: F.coalesce(
        F.sum("words").over(w.Window.partitionBy(*of).orderBy(by).rowsBetween(w.Window.unboundedPreceding, -1)), F.lit(0)
    )
    blocks = sums.groupBy("of", "block").agg(F.sum("words").alias("words")).select(
        F.col("of").alias("block_of"), F.col("block").alias("number"), upto("block", "of").alias("earlier")
    )
    same_block = F.col("of").eqNullSafe(F.col("block_of")) & (F.col("block") == F.col("number"))
    sums = sums.withColumn("base", upto("at", "of", "block")).join(blocks, same_block).select(
        "of", "at", (F.col("base") + F.col("earlier")).alias("base")
    )
    inside = w.Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(w.Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    ordered = placed.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))).withColumn("before", before)

    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    if whole:
        part = F.when(2 * rest > F.col("size"), F.col("size")).otherwise(0)
    return ordered.select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
