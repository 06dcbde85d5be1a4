"""Builds and their refresh: manifest, provenance, gates, differences, reuse."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w
from pyspark.sql.types import LongType

from ..shared import settled_all
from . import search as s

# Ratios of the gates, and the fields that a search needs of a manifest row.
RECORD_DROP, SIZE_CHANGE = 0.2, 0.5
RUNTIME_FIELDS = (
    "source_id", "source_name", "source_kind", "document_kind", "programming_language", "docs_locale", "status", "reason", "path",
    "record_count", "gzip_bytes", "brotli_bytes", "qualification", "qualification_ja"
)


@F.pandas_udf(LongType())
def gzip_size(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else len(gzip.compress(b.encode(), 9, mtime=0)))


def select_jobs(
    jobs: DataFrame, sources: list[str] | None = None, excluded: list[str] = (), frequencies: list[str] | None = None
) -> DataFrame:
    """Jobs of the selectors (``source`` or ``source/locale``) and frequencies, without the excluded. Selectors that no job has,
    and an empty selection, are errors."""
    name, full = F.col("source_id"), F.concat_ws("/", "source_id", "docs_locale")
    for asked in (sources or [], excluded):
        known = {
            x for r in jobs.where(name.isin(*asked) | full.isin(*asked)).select(name.alias("a"), full.alias("b")).distinct().collect() for x in r
        } if asked else set()
        if missing := set(asked) - known:
            raise ValueError(f"no job for {sorted(missing)}")
    out = jobs if sources is None else jobs.where(name.isin(*sources) | full.isin(*sources))
    out = out.where(~(name.isin(*excluded) | full.isin(*excluded))) if excluded else out
    out = out if frequencies is None else out.where(F.col("update_frequency").isin(*frequencies))
    if out.isEmpty():
        raise ValueError("the selection has no job")
    return out


def build_manifest(catalog: dict[str, DataFrame], bundles: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row for each catalog index, in catalog order. Sizes and hashes only where the index is supported and was built. Brotli
    sizes are those that ``bundles`` bring, if they do."""
    indexes, sources = catalog["source_indexes"], catalog["sources"].drop("catalog_pos", "source_pos")
    brotli = F.col("brotli_bytes").cast("long") if "brotli_bytes" in bundles.columns else F.lit(None).cast("long")
    sizes = bundles.withColumns({"gzip_bytes": gzip_size("body"), "brotli_bytes": brotli}).drop("body")
    built = sizes.join(provenance, ["source_id", "docs_locale"], "left")
    rows = indexes.join(F.broadcast(sources), "source_id").join(built, ["source_id", "docs_locale"], "left")
    ready = F.col("status") == "supported"
    kept = (
        "path", "url_prefix", "record_count", "raw_bytes", "gzip_bytes", "brotli_bytes", "output_sha256", "input_sha256", "retrieved_at"
    )
    return rows.select(
        F.row_number().over(
            w.Window.orderBy("catalog_pos", "source_pos", "index_pos")
        ).alias("manifest_pos"), "source_id", "source_name", "source_kind", "document_kind",
        F.col("language_id").alias("programming_language"), "docs_locale", "status", "reason", "qualification", "qualification_ja", *(
            F.when(ready, F.col(c)).alias(c) for c in kept
        ),
    )


def runtime_projection(manifest: DataFrame) -> DataFrame:
    """(manifest_pos, entry): the JSON of the fields that a search needs, without nulls."""
    return manifest.select("manifest_pos", F.to_json(F.struct(*RUNTIME_FIELDS)).alias("entry"))


def input_provenance(fetches: DataFrame) -> DataFrame:
    """From (source_id, docs_locale, url, body, canonicalizer): sorted inputs with hashes, and the hash over
    ``url NUL [canonicalizer NUL] sha256`` lines. An index has few inputs; bodies are hashed before they meet."""
    hashed = fetches.select("source_id", "docs_locale", "url", F.sha2("body", 256).alias("sha256"), "canonicalizer")
    inputs = hashed.groupBy("source_id", "docs_locale").agg(
        F.array_sort(F.collect_list(F.struct("url", "sha256", "canonicalizer"))).alias("inputs")
    )
    line = F.array_join(F.transform("inputs", lambda x: F.concat_ws("\0", x["url"], x["canonicalizer"], x["sha256"])), "\n")
    return inputs.withColumn("input_sha256", F.sha2(line, 256))


def canonical_links(links: DataFrame) -> DataFrame:
    """(doc_id, canonical): the sorted different URLs of a document's links, which decoration doesn't change."""
    return links.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("url")), "\n").alias("canonical"))


def manifest_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "docs_locale")) -> DataFrame:
    """(keys, change, fields): added, removed or changed rows; of changed ones the names of the fields."""
    fields = [c for c in new.columns if c not in keys and c in old.columns]
    pack = lambda df, side: df.select(*keys, F.struct(*fields).alias(side))
    met = pack(old, "o").join(pack(new, "n"), list(keys), "full")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in fields)))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size("fields") > 0, "changed")
    return met.withColumn(
        "fields", F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), differing).otherwise(F.array().cast("array<string>"))
    ).withColumn("change", change).where("change is not null").select(*keys, "change", "fields")


def header_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field) of the top-level fields of two manifests (schema_version, generator_version, catalog_sha256; a row each) that
    differ. None is a build's precondition for reusing artifacts of the other."""
    fields = ("schema_version", "generator_version", "catalog_sha256")
    met = old.select(*(F.col(c).alias(f"old_{c}") for c in fields)).join(new.select(*fields), F.lit(True), "full")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"old_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in fields)))
    return met.select(F.explode(differing).alias("field"))


def artifact_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of (path, sha256): missing, changed, obsolete."""
    met = old.select("path", F.col("sha256").alias("o")).join(new.select("path", F.col("sha256").alias("n")), "path", "full")
    return met.withColumn(
        "change", F.when(F.col("o").isNull(), "missing").when(F.col("n").isNull(), "obsolete").when(F.col("o") != F.col("n"), "changed")
    ).where("change is not null").select("path", "change")


def carry_over(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Inputs (source_id, docs_locale, url, sha256, canonicalizer, etag, last_modified) whose content is as before keep the
    earlier etag and date."""
    key = ["source_id", "docs_locale", "url", "sha256"]
    before = previous.select(
        *key, F.coalesce("canonicalizer", F.lit("")).alias("_c"), F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified")
    )
    met = current.withColumn("_c", F.coalesce("canonicalizer", F.lit(""))).join(before, [*key, "_c"], "left")
    return met.withColumn("etag", F.coalesce("_etag", "etag")).withColumn(
        "last_modified", F.coalesce("_modified", "last_modified")
    ).select(*current.columns)


def keep_retrieved_at(previous: DataFrame, current: DataFrame) -> DataFrame:
    """retrieved_at stays while the combined input hash does."""
    before = previous.select("source_id", "docs_locale", F.col("input_sha256").alias("_sha"), F.col("retrieved_at").alias("_at"))
    met = current.join(before, ["source_id", "docs_locale"], "left")
    return met.withColumn(
        "retrieved_at", F.when(F.col("_sha") == F.col("input_sha256"), F.col("_at")).otherwise(F.col("retrieved_at"))
    ).select(*current.columns)


def change_gates(previous: DataFrame, current: DataFrame, jobs: DataFrame | None = None, accepted: list[str] = ()) -> DataFrame:
    """(source_id, docs_locale, gate, before, after) of indexes that lose too many records or change size too much."""
    sizes = [c for c in ("gzip_bytes", "brotli_bytes") if c in previous.columns and c in current.columns]
    b = previous.select("source_id", "docs_locale", F.col("record_count").alias("n0"), *(F.col(c).alias(f"{c}0") for c in sizes))
    rows = current.select("source_id", "docs_locale", F.col("record_count").alias("n1"), *sizes).join(b, ["source_id", "docs_locale"])
    drop, change = F.lit(RECORD_DROP), F.lit(SIZE_CHANGE)
    if jobs is not None:
        rows = rows.join(
            F.broadcast(jobs.select("source_id", "docs_locale", "maximum_record_drop_ratio", "maximum_size_change_ratio")),
            ["source_id", "docs_locale"], "left"
        )
        drop, change = F.coalesce("maximum_record_drop_ratio", drop), F.coalesce("maximum_size_change_ratio", change)
    fewer = F.when(
        (F.col("n0") > 0) & ((F.col("n0") - F.col("n1")) / F.col("n0") > drop),
        F.struct(F.lit("records").alias("gate"), F.col("n0").alias("before"), F.col("n1").alias("after"))
    )
    resized = [
        F.when(
            (F.col(f"{c}0") > 0) & (F.abs(F.col(c) - F.col(f"{c}0")) / F.col(f"{c}0") > change),
            F.struct(F.lit(c).alias("gate"), F.col(f"{c}0").cast("long").alias("before"), F.col(c).cast("long").alias("after"))
        ) for c in sizes
    ]
    rows = rows.where(~F.concat_ws("/", "source_id", "docs_locale").isin(*accepted)) if accepted else rows
    return rows.select(
        "source_id", "docs_locale", F.explode(F.array_compact(F.array(fewer, *resized))).alias("g")
    ).select("source_id", "docs_locale", "g.*")


def partial_refresh(
    selected: DataFrame, previous: DataFrame, fresh: DataFrame, artifacts: DataFrame, metadata: tuple[str, ...],
    headers: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """The next manifest when only ``selected`` (source_id, docs_locale) was built: those rows from ``fresh``, the others from
    ``previous`` if their metadata still equals the catalog's (as in ``fresh``) and their artifact (path, sha256, record_count,
    raw_bytes) is sound. ``origin`` says which; ``fault`` why a row can't be reused. With the ``headers`` of both manifests, a
    difference between these is an error, and so is a selected index that is not supported."""
    if headers is not None:
        if changed := [r.field for r in header_diff(*headers).collect()]:
            raise ValueError(f"nothing can be reused after changes of {', '.join(sorted(changed))}")
        ready = fresh.where("status = 'supported'").select("source_id", "docs_locale")
        if odd := selected.join(ready, ["source_id", "docs_locale"], "left_anti").take(5):
            raise ValueError(f"not supported: {[tuple(r) for r in odd]}")
    key = ["source_id", "docs_locale"]
    built = fresh.join(
        selected.select(*key), key, "left_semi"
    ).withColumn("origin", F.lit("built")).withColumn("fault", F.lit(None).cast("string"))
    now = fresh.select(*key, F.struct(*metadata).alias("_now"))
    held = artifacts.select(
        F.col("path").alias("_path"), F.col("sha256").alias("_sha"), F.col("record_count").alias("_n"), F.col("raw_bytes").alias("_raw")
    )
    old = previous.join(selected.select(*key), key, "left_anti").join(now, key, "left").join(held, F.col("path") == F.col("_path"), "left")
    fault = (
        F.when(F.col("_now").isNull(), "not in catalog").when(~F.struct(*metadata).eqNullSafe(F.col("_now")), "metadata")
        .when(F.col("status") != "supported", F.lit(None)).when(F.col("_path").isNull(), "missing artifact").when(
            ~F.col("output_sha256").eqNullSafe(F.col("_sha")), "hash"
        )
        .when(
            ~F.col("record_count").eqNullSafe(F.col("_n")), "count"
        ).when(~F.col("raw_bytes").eqNullSafe(F.col("_raw")), "size").when(F.col("input_sha256").isNull(), "provenance")
    )
    reused = old.withColumn("origin", F.lit("reused")).withColumn("fault", fault)
    return built.unionByName(reused.select(*built.columns))


def size_budget_report(manifest: DataFrame, default_languages: int = 4, size: str = "gzip_bytes") -> DataFrame:
    """(measure, bytes): largest bundle; all official English bundles of the first languages; the largest bundles of the
    four languages that have the largest."""
    rows = manifest.where(F.col("status") == "supported").select(
        "programming_language", "docs_locale", "source_kind", "manifest_pos", F.col(size).alias("b")
    )
    by_lang = rows.groupBy("programming_language").agg(
        F.max("b").alias("b"), F.min("manifest_pos").alias("p"),
        F.sum(F.when((F.col("docs_locale") == "en") & (F.col("source_kind") == "official"), F.col("b")).otherwise(0)).alias("official")
    )
    placed = by_lang.withColumn("by_pos", F.row_number().over(w.Window.orderBy("p"))).withColumn(
        "by_size", F.row_number().over(w.Window.orderBy(F.col("b").desc(), "programming_language"))
    )
    totals = placed.agg(
        F.max("b").alias("largest bundle"),
        F.sum(F.when(F.col("by_pos") <= default_languages, F.col("official"))).alias("default languages"),
        F.sum(F.when(F.col("by_size") <= 4, F.col("b"))).alias("largest of top languages")
    )
    return totals.select(
        F.explode(
            F.map_from_arrays(F.array(*map(F.lit, totals.columns)), F.array(*(F.col(f"`{c}`").cast("long") for c in totals.columns)))
        ).alias("measure", "bytes")
    )


def known_query_check(jobs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, failures): for each job's known query the record to check, with that very title or else the first that has all
    its tokens; and the known queries that hit nothing in their index."""
    return settled_all(jobs.sparkSession, lambda: _known_query_check(jobs, records))


def _known_query_check(jobs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = jobs.select(
        F.col("source_id").alias("j_source"), F.col("docs_locale").alias("j_locale"), F.explode("known_queries").alias("query")
    ).withColumn("query_id", F.concat_ws("\0", "j_source", "j_locale", "query")).distinct()
    queries = s.tokenized(asked).join(asked, "query_id")
    pairs = s.match_exact(queries, s.prepared(records), same={"source_id": "j_source", "docs_locale": "j_locale"})
    best = F.min_by(F.struct("title", "url"), F.struct(F.when(F.col("t") == F.col("q"), 0).otherwise(1), F.col("pos")))
    hits = pairs.groupBy("j_source", "j_locale", "query").agg(best.alias("hit"))
    named = lambda df, *more: df.select(
        F.col("j_source").alias("source_id"), F.col("j_locale").alias("docs_locale"), "query", *more
    )
    return named(hits, "hit.title", "hit.url"), named(asked.join(hits, ["j_source", "j_locale", "query"], "left_anti"))


def live_check_rows(manifest: DataFrame, hits: DataFrame) -> DataFrame:
    """Result links to check live: the hits of supported indexes, one for each URL."""
    ready = manifest.where("status = 'supported'").select("source_id", "docs_locale")
    return hits.join(F.broadcast(ready), ["source_id", "docs_locale"], "left_semi").groupBy("url").agg(
        F.min(F.struct("source_id", "docs_locale", "query")).alias("of")
    ).select("url", "of.*")


def projection_equivalence(requests: DataFrame, full: DataFrame, projected: DataFrame, **options) -> DataFrame:
    """Result rows that differ between searches over two tables of records; none if they are equivalent."""
    a, _ = s.search(requests, full, **options)
    b, _ = s.search(requests, projected, **options)
    return a.exceptAll(b).withColumn("only", F.lit("full")).unionByName(b.exceptAll(a).withColumn("only", F.lit("projected")))


