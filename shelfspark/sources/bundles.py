"""Index bundles: one ordered list of records for each source and locale, with content-addressed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from ..functions.urls import url_resolve
from ..shared import cut

BUNDLE = "schemaVersion int, sourceId string, docsLocale string, urlPrefix string, first bigint, records array<array<string>>"

#: Records of a part of a bundle.
PART_ROWS = 20_000
SCHEMA_VERSION, GENERATOR_VERSION = 2, 1


def read_bundles(spark: SparkSession, path: str | list[str], base: str | None = None) -> DataFrame:
    """One row for each bundle file: its fields in snake case and path, the file's name, or its folder's where publish_bundles()
    wrote it, in ``base`` if only some of those are named."""
    reader = spark.read.option("basePath", base) if base else spark.read
    raw = reader.schema(BUNDLE + ", path string").json(path, multiLine=True)
    name = F.coalesce("path", F.col("_metadata.file_name"))
    return raw.select(
        F.col("schemaVersion").alias("schema_version"), F.col("sourceId").alias("source_id"), F.col("docsLocale").alias("docs_locale"),
        F.col("urlPrefix").alias("url_prefix"), "records", name.alias("path"), F.coalesce("first", F.lit(0)).alias("first")
    )


def explode_records(bundles: DataFrame) -> DataFrame:
    """One row for each record with its position in the bundle: title, url_suffix, section, proposal_status; empty fields are
    null. A part of a bundle says where it begins (``first``)."""
    field = lambda i: F.nullif(F.get("rec", F.lit(i)), F.lit(""))
    first = F.col("first") if "first" in bundles.columns else F.lit(0)
    return bundles.select("source_id", "docs_locale", "url_prefix", first.alias("first"), F.posexplode("records").alias("pos", "rec")).select(
        "source_id", "docs_locale", "url_prefix", (F.col("first") + F.col("pos")).cast("long").alias("pos"), F.get("rec", F.lit(0)).alias("title"),
        F.get("rec", F.lit(1)).alias("url_suffix"), field(2).alias("section"), field(3).alias("proposal_status")
    )


def expand_bundles(bundles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Search records: absolute URLs and the manifest's metadata. The manifest has one row for each bundle."""
    meta = manifest.select(
        "source_id", "docs_locale", "source_name", "source_kind", F.coalesce("document_kind", F.lit("reference")).alias("document_kind"),
        "programming_language", "qualification", "qualification_ja"
    )
    return explode_records(bundles).join(meta, ["source_id", "docs_locale"]).withColumn(
        "url", F.concat("url_prefix", "url_suffix")
    ).drop("url_prefix", "url_suffix")


def validate_bundles(bundles: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, docs_locale, reason) of bundles that a search must leave out; other bundles are not affected."""
    known = manifest.select(
        F.col("source_id").alias("m_source"), F.col("docs_locale").alias("m_locale"), F.col("path").alias("m_path"), "record_count"
    )
    met = bundles.join(known, F.col("path") == F.col("m_path"), "left")
    sound = F.forall("records", lambda r: F.size(r).between(2, 4) & ~F.exists(r, F.isnull) & (F.trim(F.get(r, F.lit(0))) != ""))
    reason = (
        F.when(F.col("m_path").isNull(), "unknown")
        .when((F.col("source_id") != F.col("m_source")) | (F.col("docs_locale") != F.col("m_locale")), "identity")
        .when(F.col("schema_version") != SCHEMA_VERSION, "schema")
        .when(~F.coalesce(sound, F.lit(False)), "record")
        .when(F.size("records") != F.col("record_count"), "count")
    )
    faulty = met.select("source_id", "docs_locale", "path", reason.alias("reason")).where("reason is not null")
    urls = explode_records(bundles).withColumn("full", F.concat("url_prefix", "url_suffix"))
    outside = urls.where(
        ~F.coalesce(
            F.startswith(url_resolve(F.lit(""), F.col("full")), F.col("url_prefix")) & F.startswith("full", F.lit("https://")), F.lit(False)
        )
    )
    outside = outside.select("source_id", "docs_locale").distinct().join(
        bundles.select("source_id", "docs_locale", "path"), ["source_id", "docs_locale"]
    ).withColumn("reason", F.lit("url"))
    return faulty.unionByName(outside.join(faulty.select("path"), "path", "left_anti"))


def _short(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records as they are stored: the job's prefix and trailing empty fields are gone."""
    fields = F.array(
        F.col("title"), F.substr("url", F.length("url_prefix") + 1), F.coalesce("section", F.lit("")),
        F.coalesce("proposal_status", F.lit(""))
    )
    used = F.when(F.coalesce("proposal_status", F.lit("")) != "", 4).when(F.coalesce("section", F.lit("")) != "", 3).otherwise(2)
    rows = records.join(F.broadcast(jobs.select("source_id", "docs_locale", "url_prefix")), ["source_id", "docs_locale"])
    return rows.select("source_id", "docs_locale", "url_prefix", "pos", F.slice(fields, F.lit(1), used).alias("rec"))


def _bodies(packed: DataFrame, first: Column) -> DataFrame:
    """With the JSON line of the sorted records, its count and its bytes."""
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.col("source_id").alias("sourceId"), F.col("docs_locale").alias("docsLocale"),
        F.col("url_prefix").alias("urlPrefix"), first.alias("first"), F.transform("sorted", lambda x: x["rec"]).alias("records")
    )
    return packed.withColumn("body", F.concat(F.to_json(body), F.lit("\n"))).withColumns(
        {"record_count": F.size("sorted").cast("long"), "raw_bytes": F.octet_length("body").cast("long")}
    )


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, their place by pos among those of equal keys, from 0 on. Rows are dealt by ranges, and each range
    counts its own, so a large index is ranked by many tasks; the counts are a row for each range and index in it."""
    dealt = rows.repartitionByRange(*keys, "pos").sortWithinPartitions(*keys, "pos")
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    counts = dealt.groupBy("_range", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = w.Window.partitionBy(*keys).orderBy("_range").rowsBetween(w.Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.join(counts, ["_range", *keys])
    return ranked.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_before")


def pack_parts(records: DataFrame, jobs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each part of the bundles of (source, locale): part, parts, first, record_count, body, raw_bytes, part_sha256,
    output_sha256 and path. A part holds ``part_rows`` records at most. A bundle's hash is that of its parts' hashes in order, a
    tree of two levels; a bundle of one part has the bytes, the hash and the name that ``pack_bundles`` gives it."""
    keys = ["source_id", "docs_locale", "url_prefix"]
    rows = _ranked(_short(records, jobs), keys).withColumn("part", F.floor(F.col("_rank") / part_rows))
    packed = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "rec"))).alias("sorted"))
    first = (F.col("part") * part_rows).cast("long")
    later = F.when(F.col("part") > 0, first)  # left out of the JSON of first parts
    packed = _bodies(packed.withColumn("first", first), later).withColumn("part_sha256", F.sha2("body", 256))
    packed = cut(packed.drop("sorted"))
    hashes = F.array_sort(F.collect_list(F.struct("part", "part_sha256")))
    root = packed.groupBy(*keys).agg(F.transform(hashes, lambda x: x["part_sha256"]).alias("hashes")).withColumn("parts", F.size("hashes"))
    root = root.withColumn(
        "output_sha256", F.when(F.col("parts") == 1, F.get("hashes", F.lit(0))).otherwise(F.sha2(F.array_join("hashes", "\n"), 256))
    ).drop("hashes")
    name = [F.col("source_id"), F.col("docs_locale"), F.left("output_sha256", F.lit(16))]
    number = F.when(F.col("parts") > 1, F.lpad(F.col("part").cast("string"), 6, "0"))
    return packed.join(root, keys).withColumn("path", F.concat_ws(".", *name, number, F.lit("json")))


def validate_parts(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, docs_locale, reason) of bundles in parts that a search must leave out. Parts (source_id, docs_locale, part, body)
    are hashed one by one, and met with the manifest (source_id, docs_locale, record_count, output_sha256) as hashes."""
    read = parts.select(
        "source_id", "docs_locale", "part", F.sha2("body", 256).alias("sha"), F.from_json("body", BUNDLE).alias("b")
    ).select("source_id", "docs_locale", "part", "sha", F.coalesce("b.first", F.lit(0)).alias("first"), F.size("b.records").alias("n"), F.coalesce(
        (F.col("b.schemaVersion") == SCHEMA_VERSION) & (F.col("b.sourceId") == F.col("source_id")) & (F.col("b.docsLocale") == F.col("docs_locale"))
        & F.forall("b.records", lambda r: F.size(r).between(2, 4) & ~F.exists(r, F.isnull) & (F.trim(F.get(r, F.lit(0))) != "")),
        F.lit(False)
    ).alias("sound"))
    seen = read.groupBy("source_id", "docs_locale").agg(
        F.array_sort(F.collect_list(F.struct("part", "sha", "first", "n"))).alias("parts"), F.min("sound").alias("sound"), F.sum("n").alias("n")
    )
    hashes = F.transform("parts", lambda x: x["sha"])
    root = F.when(F.size("parts") == 1, F.get(hashes, F.lit(0))).otherwise(F.sha2(F.array_join(hashes, "\n"), 256))
    ends = F.aggregate("parts", F.lit(0).cast("long"), lambda at, x: F.when(x["first"] == at, at + x["n"]))
    met = manifest.select("source_id", "docs_locale", "record_count", "output_sha256").join(seen, ["source_id", "docs_locale"], "full")
    reason = (
        F.when(F.col("record_count").isNull(), "unknown")
        .when(F.col("parts").isNull(), "missing")
        .when(~F.coalesce("sound", F.lit(False)), "record")
        .when(F.coalesce(ends, F.lit(-1)) != F.col("n"), "order")
        .when(F.col("n") != F.col("record_count"), "count")
        .when(root != F.col("output_sha256"), "hash")
    )
    return met.select("source_id", "docs_locale", reason.alias("reason")).where("reason is not null")


def pack_bundles(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for each (source, locale): the bundle's JSON line, its sizes, hash and name. URLs lose the job's prefix, trailing
    empty fields go. A bundle is one published file, so it is one row; ``pack_parts`` packs indexes of any size."""
    keys = ["source_id", "docs_locale", "url_prefix"]
    packed = _short(records, jobs).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "rec"))).alias("sorted"))
    packed = _bodies(packed, F.lit(None).cast("long")).withColumn("output_sha256", F.sha2("body", 256))
    return packed.select(
        "source_id", "docs_locale", "url_prefix", "record_count", "body", "raw_bytes", "output_sha256",
        F.concat_ws(".", "source_id", "docs_locale", F.left("output_sha256", F.lit(16)), F.lit("json")).alias("path")
    )


def publish_records(records: DataFrame, path: str) -> None:
    """Records by source and locale. The rows are spread over all tasks first, so a large source makes many files."""
    records.write.mode("overwrite").partitionBy("source_id", "docs_locale").parquet(path)


def write_bundles(bundles: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON file for each bundle, in a folder of its name, beside those that are there."""
    bundles.select("path", F.rtrim("body").alias("body")).write.mode(mode).partitionBy("path").text(path)


def publish_bundles(bundles: DataFrame, path: str) -> None:
    """One JSON file for each bundle, instead of what was there; ``publishing.publish_build`` keeps the old build meanwhile."""
    write_bundles(bundles, path, "overwrite")


def publish_manifest(
    manifest: DataFrame, path: str, catalog_sha256: str, schema_version: int = SCHEMA_VERSION, generator_version: int = GENERATOR_VERSION
) -> None:
    """One JSON document: versions, the catalog's hash, and the rows as entries in their order. A manifest has a row for each
    index of the catalog, some hundreds."""
    fields = [c for c in manifest.columns if c != "manifest_pos"]
    entries = F.array_sort(F.collect_list(F.struct("manifest_pos", F.struct(*fields).alias("entry"))))
    whole = manifest.agg(F.transform(entries, lambda x: x["entry"]).alias("entries"))
    head = F.struct(
        F.lit(schema_version).alias("schemaVersion"), F.lit(generator_version).alias("generatorVersion"),
        F.lit(catalog_sha256).alias("catalogSha256"), "entries"
    )
    whole.select(F.to_json(head).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, entry: str) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of a published manifest; ``entry`` is the schema of its entries."""
    raw = spark.read.schema(
        f"schemaVersion int, generatorVersion int, catalogSha256 string, entries array<struct<{entry}>>"
    ).json(path, multiLine=True)
    header = raw.select(
        F.col("schemaVersion").alias("schema_version"), F.col("generatorVersion").alias("generator_version"),
        F.col("catalogSha256").alias("catalog_sha256")
    )
    rows = raw.select(F.posexplode("entries").alias("pos", "entry"))
    return header, rows.select((F.col("pos") + 1).alias("manifest_pos"), "entry.*")
