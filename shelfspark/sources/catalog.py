"""The catalog of languages, sources and their indexes: a small TOML document, flattened to tables."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_language_id

# Kinds and statuses.
SOURCE_KINDS = ("official", "conventional", "community")
DOCUMENT_KINDS = ("reference", "specification", "proposal", "design-record")
STATUSES = ("supported", "planned", "blocked", "disabled")

_INDEX = "locale string, status string, reason string"
_SOURCE = f"id string, kind string, document_kind string, name string, url string, domains array<string>, path_prefixes array<string>, default_enabled boolean, site_locales array<string>, qualification_en string, qualification_ja string, indexes array<struct<{_INDEX.replace(' string', ':string')}>>"
_LANGUAGE = "id string, name string, aliases array<string>, bare_aliases array<string>, auto_non_official_fallback boolean, sources array<struct<" + _SOURCE.replace(" array", ":array").replace(" string", ":string").replace(" boolean", ":boolean") + ">>"


def load_catalog(spark: SparkSession, toml: str) -> dict[str, DataFrame]:
    """Tables languages, language_aliases, sources and source_indexes. The text is a hand-kept file of some kB."""
    import json

    raw = [json.dumps(x) for x in tomllib.loads(toml).get("languages", [])]
    rows = spark.createDataFrame(
        [(i, x) for i, x in enumerate(raw)], "catalog_pos int, raw string"
    ).select("catalog_pos", F.from_json("raw", _LANGUAGE).alias("x")).select("catalog_pos", "x.*")
    return flatten_catalog(rows)


def flatten_catalog(tree: DataFrame) -> dict[str, DataFrame]:
    """From one row for each language with nested sources. Kinds that are not known count as the first kind."""
    empty = F.array().cast("array<string>")
    languages = tree.select(
        "catalog_pos", "id", F.coalesce("name", "id").alias("name"), F.coalesce("aliases", empty).alias("aliases"),
        F.coalesce("bare_aliases", empty).alias("bare_aliases"),
        F.coalesce("auto_non_official_fallback", F.lit(False)).alias("auto_non_official_fallback")
    )
    names = F.concat(F.array("id"), F.col("aliases"), F.col("bare_aliases"))
    aliases = languages.select(
        "catalog_pos", F.col("id").alias("language_id"), F.explode(F.transform(names, normalize_language_id)).alias("alias")
    ).distinct()
    s = tree.select("catalog_pos", F.col("id").alias("language_id"), F.posexplode("sources").alias("source_pos", "s"))
    kind = lambda c, known: F.when(F.col(c).isin(*known), F.col(c)).otherwise(known[0])
    sources = s.select(
        "catalog_pos", "source_pos", "language_id", F.col("s.id").alias("source_id"), kind("s.kind", SOURCE_KINDS).alias("source_kind"), kind("s.document_kind", DOCUMENT_KINDS).alias("document_kind"),
        F.coalesce("s.name", "s.id").alias("source_name"), "s.url", *(
            F.coalesce(f"s.{c}", empty).alias(c) for c in ("domains", "path_prefixes", "site_locales")
        ), F.coalesce("s.default_enabled", F.lit(True)).alias("default_enabled"),
        F.nullif(
            F.trim("s.qualification_en"), F.lit("")
        ).alias("qualification"), F.nullif(F.trim("s.qualification_ja"), F.lit("")).alias("qualification_ja"),
    )
    indexes = s.select("catalog_pos", "source_pos", F.col("s.id").alias("source_id"), F.posexplode("s.indexes").alias("index_pos", "i")).select(
        "catalog_pos", "source_pos", "index_pos", "source_id", F.col("i.locale").alias("docs_locale"), "i.status",
        F.nullif(F.trim("i.reason"), F.lit("")).alias("reason")
    )
    return {"languages": languages, "language_aliases": aliases, "sources": sources, "source_indexes": indexes}


def catalog_integrity(catalog: dict[str, DataFrame]) -> DataFrame:
    """(rule, id, detail) of every fault; no row if the catalog is sound."""
    languages, aliases, sources, indexes = (catalog[k] for k in ("languages", "language_aliases", "sources", "source_indexes"))
    n, say = F.count("*").alias("n"), lambda df, rule, key, detail: df.select(
        F.lit(rule).alias("rule"), F.col(key).alias("id"), detail.cast("string").alias("detail")
    )
    faults = [
        say(languages.groupBy("id").agg(n).where("n > 1"), "duplicate language", "id", F.col("n")),
        say(sources.groupBy("source_id").agg(n).where("n > 1"), "duplicate source", "source_id", F.col("n")),
        say(
            aliases.groupBy("alias").agg(F.count_distinct("language_id").alias("n")).where("n > 1"), "alias of two languages", "alias",
            F.col("n")
        ),
        say(sources.where(F.size("domains") == 0), "no domain", "source_id", F.lit("")),
        say(
            sources.select("source_id", F.explode("domains").alias("d")).where(F.rlike("d", F.lit("[:/]"))), "domain is not a host",
            "source_id", F.col("d")
        ),
        say(
            sources.where(F.col("qualification").isNull() != F.col("qualification_ja").isNull()), "one-sided qualification", "source_id",
            F.lit("")
        ),
        say(indexes.groupBy("source_id", "docs_locale").agg(n).where("n > 1"), "repeated locale", "source_id", F.col("docs_locale")),
        say(
            indexes.where((F.col("status") != "supported") & F.col("reason").isNull()), "missing reason", "source_id", F.col("docs_locale")
        ),
        say(indexes.where(~F.col("status").isin(*STATUSES)), "unknown status", "source_id", F.col("status")),
        say(
            sources.join(indexes.groupBy("source_id").agg(F.collect_set("docs_locale").alias("have")), "source_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>"))).where(
                (F.size(F.array_except("site_locales", "have")) > 0) | (F.size(F.array_except("have", "site_locales")) > 0)
            ),
            "locales are not the indexes", "source_id", F.concat_ws(",", F.array_sort("have")),
        ),
    ]
    return reduce(DataFrame.unionByName, faults)


def coverage_report(catalog: dict[str, DataFrame]) -> DataFrame:
    """For each language: sources, sources and indexes that are supported, their locales, reasons of the others."""
    sources, indexes = catalog["sources"].select("language_id", "source_id"), catalog["source_indexes"].select(
        "source_id", "docs_locale", "status", "reason"
    )
    ready = F.col("status") == "supported"
    return sources.join(indexes, "source_id", "left").groupBy("language_id").agg(
        F.count_distinct("source_id").alias("sources"),
        F.count_distinct(F.when(ready, F.col("source_id"))).alias("indexed_sources"),
        F.count_if(ready).alias("indexes"),
        F.array_sort(F.collect_set(F.when(ready, F.col("docs_locale")))).alias("locales"),
        F.array_sort(F.collect_set(F.when(~ready, F.col("reason")))).alias("pending_reasons"),
    )


def job_catalog_match(jobs: DataFrame, indexes: DataFrame) -> DataFrame:
    """(source_id, docs_locale, fault): supported indexes without a job, jobs without one, repeated jobs."""
    counted = jobs.groupBy("source_id", "docs_locale").agg(F.count("*").alias("n"))
    ready = indexes.where("status = 'supported'").select("source_id", "docs_locale", F.lit(True).alias("ready")).distinct()
    fault = F.when(F.col("n").isNull(), "no job").when(F.col("ready").isNull(), "no index").when(F.col("n") > 1, "repeated job")
    return counted.join(ready, ["source_id", "docs_locale"], "full").select(
        "source_id", "docs_locale", fault.alias("fault")
    ).where("fault is not null")
