"""A search request end to end: which indexes, which of them are sound, the search, and what could not be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scope as sc
from . import search as s


def failed_sources(chosen: DataFrame, faults: DataFrame) -> DataFrame:
    """(query_id, source_id, docs_locale, reason) of chosen indexes whose bundle is faulty (source_id, docs_locale, reason)."""
    bad = faults.select("source_id", F.col("docs_locale").alias("actual_locale"), F.col("reason").alias("fault")).distinct()
    met = chosen.where("outcome = 'index'").join(bad, ["source_id", "actual_locale"])
    return met.select("query_id", "source_id", F.col("actual_locale").alias("docs_locale"), F.col("fault").alias("reason"))


def run_requests(
    requests: DataFrame, manifest: DataFrame, records: DataFrame, faults: DataFrame | None = None, **options
) -> dict[str, DataFrame]:
    """Five tables keyed by query_id: records, facets, unavailable, fallback and failed.

    requests: query_id, query, docs_locale, source_ids (array) and optionally limit. Sources whose bundle is faulty are left
    out one by one; the others are searched."""
    wanted = requests.select(
        "query_id", F.coalesce("docs_locale", F.lit("")).alias("docs_locale"), F.explode(F.array_distinct("source_ids")).alias("source_id")
    )
    chosen = sc.select_indexes(wanted, manifest)
    found = chosen.where("outcome = 'index'").select("query_id", "source_id", F.col("actual_locale").alias("docs_locale"))
    failed = None
    if faults is not None:
        failed = failed_sources(chosen, faults)
        found = found.join(failed, ["query_id", "source_id", "docs_locale"], "left_anti")
    results, facets = s.search(requests.drop("docs_locale", "source_ids"), records, scope=found.distinct(), **options)
    out = {"records": results, "facets": facets}
    out["unavailable"] = chosen.where("outcome = 'unavailable'").select("query_id", "source_id", "status", "reason")
    out["fallback"] = chosen.where("fallback").select(
        "query_id", "source_id", F.col("docs_locale").alias("requested_locale"), "actual_locale"
    )
    if failed is not None:
        out["failed"] = failed
    return out
