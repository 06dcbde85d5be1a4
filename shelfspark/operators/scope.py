"""Which sources and indexes a request covers. Catalog and manifest are small tables, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from ..functions.text import normalize_language_id

# Languages without a request, locale to fall back to, preload limits.
DEFAULT_LANGUAGES = 4
FALLBACK = {"ja": "en"}
MOST_PRELOADS, MOST_PRELOAD_BYTES = 4, 500 * 1024


def resolve_scope(requests: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """One row for each request and source: requests have query_id, languages, source_mode (all or official) and optionally
    fallback (boolean: other sources where a language has none official) and enabled (array of source ids, null for all).

    Unknown languages are dropped; without any, the first ``DEFAULT_LANGUAGES`` of the catalog count. A language that is asked
    for twice, also by an alias, counts once. ``automatic`` marks sources that only the fallback lets in."""
    aliases, sources, languages = catalog["language_aliases"], catalog["sources"], catalog["languages"]
    r = requests
    for c, kind in (("fallback", "boolean"), ("enabled", "array<string>"), ("locale", "string")):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(kind))
    asked = r.select("query_id", F.explode("languages").alias("name")).withColumn("alias", normalize_language_id(F.col("name")))
    known = asked.join(
        F.broadcast(aliases.groupBy("alias").agg(F.min_by("language_id", "catalog_pos").alias("language_id"))), "alias"
    ).select("query_id", "language_id").distinct()
    default = F.broadcast(
        languages.where(F.col("catalog_pos") < DEFAULT_LANGUAGES).select(F.col("id").alias("language_id"), F.lit(1).alias("_one"))
    )
    bare = r.select("query_id", F.lit(1).alias("_one")).join(known, "query_id", "left_anti").join(default, "_one").select("query_id", "language_id")
    meta = languages.select(F.col("id").alias("language_id"), "auto_non_official_fallback")
    rows = known.unionByName(bare).join(F.broadcast(meta), "language_id").join(
        r.select("query_id", "source_mode", "fallback", "enabled", "locale"), "query_id"
    ).join(F.broadcast(sources), "language_id")
    automatic = (F.col("source_mode") == "official") & F.coalesce("fallback", F.lit(False)) & F.col("auto_non_official_fallback")
    official = F.col("source_kind") == "official"
    allowed = (F.col("source_mode") == "all") | official | automatic
    chosen = rows.where(allowed & (F.col("enabled").isNull() | F.array_contains("enabled", F.col("source_id"))))
    return chosen.withColumn("automatic", automatic & ~official).drop("enabled", "fallback", "auto_non_official_fallback")


def locale_notices(scope: DataFrame) -> DataFrame:
    """(query_id, language_id, locale, source_ids): chosen sources whose site lacks the request's locale."""
    lacking = scope.where(F.col("locale").isNotNull() & ~F.array_contains("site_locales", F.col("locale")))
    return lacking.groupBy("query_id", "language_id", "locale").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_pos", "source_id"))), lambda s: s["source_id"]).alias("source_ids")
    )


def automatic_fallbacks(scope: DataFrame) -> DataFrame:
    """(query_id, language_id, source_ids) of sources that only the fallback let in."""
    return scope.where("automatic").groupBy("query_id", "language_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_pos", "source_id"))), lambda s: s["source_id"]).alias("source_ids")
    )


def select_indexes(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row for each chosen index of (query_id, docs_locale, source_id), or one for a source without any.

    outcome ``index``: path and actual_locale, with fallback if that is not the one asked for; outcome ``unavailable``: status
    (blocked, disabled, else planned) and reason of the row of that locale, else of a blocked or disabled one, else the first.
    An empty locale takes all."""
    m = F.broadcast(
        manifest.select(
            "source_id", F.col("docs_locale").alias("actual_locale"), "status", "reason", "path", "record_count", "manifest_pos"
        )
    )
    rows = wanted.select("query_id", "source_id", F.coalesce("docs_locale", F.lit("")).alias("docs_locale")).join(m, "source_id", "left")
    ready = (F.col("status") == "supported") & F.col("path").isNotNull() & F.col("record_count").isNotNull()
    other = F.lit(False)
    for asked, instead in FALLBACK.items():
        other = other | ((F.col("docs_locale") == asked) & (F.col("actual_locale") == instead))
    level = F.when(~ready | F.col("status").isNull(), 9).when(
        (F.col("docs_locale") == "") | (F.col("docs_locale") == F.col("actual_locale")), 1
    ).when(other, 2).otherwise(9)
    rows = rows.withColumn("_level", level).withColumn("_best", F.min("_level").over(w.Window.partitionBy("query_id", "source_id")))
    found = rows.where("_best < 9 and _level = _best").select(
        "query_id", "source_id", "docs_locale", F.lit("index").alias("outcome"), "actual_locale", (F.col("_level") == 2).alias("fallback"),
        "path", "status", F.lit(None).cast("string").alias("reason")
    )
    stopped = F.col("status").isin("blocked", "disabled")
    first = F.struct(
        F.when(F.col("actual_locale") == F.col("docs_locale"), 0).when(stopped, 1).otherwise(2), F.coalesce("manifest_pos", F.lit(0))
    )
    missing = rows.where("_best = 9").groupBy("query_id", "source_id", "docs_locale").agg(
        F.min_by(
            F.struct(F.when(stopped, F.col("status")).otherwise("planned").alias("status"), F.col("reason").alias("reason")), first
        ).alias("m")
    )
    none = F.lit(None).cast("string")
    return found.unionByName(
        missing.select(
            "query_id", "source_id", "docs_locale", F.lit("unavailable").alias("outcome"), none.alias("actual_locale"),
            F.lit(False).alias("fallback"), none.alias("path"), "m.status", "m.reason"
        )
    )


def preload_plan(candidates: DataFrame) -> DataFrame:
    """(query_id, paths): of (query_id, pos, path, bytes) in order, up to ``MOST_PRELOADS`` different paths of known size that
    fit into ``MOST_PRELOAD_BYTES`` together; one that does not fit is skipped. A request has a few candidates, one a source."""
    ordered = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "bytes"))).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("paths"), F.lit(0).cast("long").alias("bytes"))

    def step(seen, x):
        fits = (x["bytes"] >= 0) & ~F.array_contains(seen["paths"], x["path"]) & (F.size(seen["paths"]) < MOST_PRELOADS) & (
            seen["bytes"] + x["bytes"] <= MOST_PRELOAD_BYTES
        )
        return F.when(
            F.coalesce(fits, F.lit(False)),
            F.struct(F.concat(seen["paths"], F.array(x["path"])).alias("paths"), (seen["bytes"] + x["bytes"]).cast("long").alias("bytes"))
        ).otherwise(seen)

    return ordered.select("query_id", F.aggregate("all", start, step, lambda s: s["paths"]).alias("paths"))
