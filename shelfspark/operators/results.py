"""Result shaping: groups of equal symbols, order, facets, pages, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

PAGE = 15


# What a qualified symbol's title has, and what goes or is replaced before titles are compared.
SYMBOL = r"::|[\p{L}\p{N}_$][.#][\p{L}\p{N}_$]|[\p{L}\p{N}_$]\s*\(\s*\)$"
EMPTY_CALL, AROUND_MARK = r"\s*\(\s*\)$", r"\s*(::|[.#])\s*"


def symbol_key(title: Column) -> Column:
    """Canonical form of a qualified symbol (``a::b``, ``a.b``, ``a#b``, ``a()``): no call at the end, no space around marks,
    single spaces elsewhere; null for other titles."""
    t = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    return F.when(F.rlike(t, F.lit(SYMBOL)), F.regexp_replace(F.regexp_replace(t, EMPTY_CALL, ""), AROUND_MARK, "$1"))


def natural_key(name: Column) -> Column:
    """Text that orders as ``name`` with its runs of digits by value: each run without leading zeros, after its length."""
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    by_value = lambda x: F.when(
        F.rlike(x, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits(x)).cast("string"), 4, "0"), digits(x))
    ).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), by_value), "")


def group_results(ranked: DataFrame, rank: str = "place") -> DataFrame:
    """``ranked`` with group_rank (the first member's rank) and member_rank. Reference records of one language and symbol
    share a group; of one source and locale only the first joins it, the others stay alone."""
    key = F.when(F.coalesce("document_kind", F.lit("reference")) == "reference", symbol_key(F.col("title")))
    rows = ranked.withColumn("_key", key)
    same = w.Window.partitionBy("query_id", "programming_language", "_key", "source_id", "docs_locale").orderBy(rank)
    rows = rows.withColumn("_shared", F.col("_key").isNotNull() & (F.row_number().over(same) == 1))
    group = w.Window.partitionBy("query_id", "programming_language", "_key", "_shared", F.when(~F.col("_shared"), F.col(rank)))
    rows = rows.withColumn("group_rank", F.min(rank).over(group)).withColumn("member_rank", F.row_number().over(group.orderBy(rank)))
    return rows.drop("_key", "_shared")


def order_groups(
    grouped: DataFrame, order: str = "relevance", names: DataFrame | None = None, collation: str | None = "UNICODE_CI_AI"
) -> DataFrame:
    """``grouped`` with group_place. By language name, ascending or descending, with numbers in names by value, groups of a
    language keep their relevance."""
    rows = grouped
    if names is not None:
        rows = rows.join(
            F.broadcast(names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))),
            F.col("programming_language") == F.col("_id"), "left"
        ).drop("_id")
    else:
        rows = rows.withColumn("_name", F.lit(None).cast("string"))
    name = natural_key(F.coalesce("_name", "programming_language"))
    name = F.collate(name, collation) if collation else name
    by = [F.col("group_rank")] if order == "relevance" else [name.desc() if order == "language-desc" else name.asc(), F.col("group_rank")]
    return rows.withColumn("group_place", F.dense_rank().over(w.Window.partitionBy("query_id").orderBy(*by))).drop("_name")


def paginate(ordered: DataFrame, size: int = PAGE) -> DataFrame:
    """With page, shown (groups up to the page's end) and total."""
    total = F.max("group_place").over(w.Window.partitionBy("query_id"))
    page = F.floor((F.col("group_place") - 1) / size)
    return ordered.withColumn("page", page.cast("int")).withColumn("total", total).withColumn(
        "shown", F.least((page + 1) * size, "total").cast("int")
    )


def facet_choices(facets: DataFrame) -> DataFrame:
    """(query_id, facet, value, label, place) of languages and sites, each facet only where it has a choice."""
    language = facets.select(
        "query_id", F.lit("language").alias("facet"), F.col("programming_language").alias("value"),
        F.col("programming_language").alias("label")
    )
    site = facets.select("query_id", F.lit("site").alias("facet"), F.col("source_id").alias("value"), F.col("source_name").alias("label"))
    rows = language.unionByName(site).distinct()
    facet = w.Window.partitionBy("query_id", "facet")
    return rows.withColumn("_n", F.count("*").over(facet)).where("_n > 1").withColumn(
        "place", F.row_number().over(facet.orderBy("label", "value"))
    ).drop("_n")


def source_notes(results: DataFrame, rank: str = "place") -> DataFrame:
    """(query_id, source_id, qualification, note_place): caveats of the sources in a result, in order of appearance."""
    first = results.where("qualification is not null").groupBy("query_id", "source_id").agg(
        F.min_by("qualification", rank).alias("qualification"), F.min(rank).alias("_rank")
    )
    return first.withColumn("note_place", F.row_number().over(w.Window.partitionBy("query_id").orderBy("_rank"))).drop("_rank")


def filter_sources(sources: DataFrame, selections: DataFrame) -> DataFrame:
    """Sources (query_id, source_id, programming_language, ...) that pass a selection (query_id, language_ids, source_ids): OR
    within a facet, AND across; values that no source has don't count, and an empty facet keeps all."""
    have = sources.groupBy("query_id").agg(F.collect_set("programming_language").alias("_langs"), F.collect_set("source_id").alias("_ids"))
    chosen = selections.join(have, "query_id").select(
        "query_id", F.array_intersect("language_ids", "_langs").alias("_l"), F.array_intersect("source_ids", "_ids").alias("_s")
    )
    passes = lambda picked, c: F.col(picked).isNull() | (F.size(picked) == 0) | F.array_contains(picked, F.col(c))
    return sources.join(chosen, "query_id", "left").where(passes("_l", "programming_language") & passes("_s", "source_id")).drop("_l", "_s")
