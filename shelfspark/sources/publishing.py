"""Builds that are published whole: content-addressed files first, the pointer to their manifest last.

A bundle's name holds its hash, so a bundle that is there already is not written again. The manifest goes to a folder of its own
and counts once the pointer names it (``versions``); until then, and if a publication fails on the way, readers see the build
before. Files that neither the current nor the build before names are removed after the switch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bundles as b
from . import versions


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The bundles that are there: a catalog has some hundreds."""
    return [x.removeprefix("path=") for x in versions.listed(spark, f"{folder}/bundles") if x.startswith("path=")]


def publish_build(bundles: DataFrame, manifest: DataFrame, folder: str, catalog_sha256: str) -> dict[str, int]:
    """Publish packed bundles (path, body) and their manifest (manifest_pos, path and more) as the next build: how many bundles
    were written, kept and removed."""
    spark = bundles.sparkSession
    now = versions.current(spark, folder)
    there = _names(spark, folder)
    fresh = bundles.where(~F.col("path").isin(there)) if there else bundles
    b.write_bundles(fresh, f"{folder}/bundles")
    wanted = {r[0] for r in manifest.select("path").where("path is not null").collect()}
    have = set(_names(spark, folder))
    if wanted - have:
        raise ValueError(f"the manifest names bundles that are not there: {sorted(wanted - have)[:5]}")
    name = uuid.uuid4().hex
    b.publish_manifest(manifest, f"{folder}/manifests/{name}", catalog_sha256)
    versions.commit(spark, folder, {"manifest": name, "bundles": sorted(wanted)}, now and now[0])
    removed = prune(spark, folder)
    return {"written": len(have - set(there)), "kept": len(have & set(there) & wanted), "removed": removed}


def prune(spark: SparkSession, folder: str) -> int:
    """Remove what neither the current nor the build before names; the number of bundles removed."""
    states = versions.forget(spark, folder)
    live, manifests = {x for s in states for x in s["bundles"]}, {s["manifest"] for s in states}
    gone = [x for x in _names(spark, folder) if x not in live]
    for x in gone:
        versions.delete(spark, f"{folder}/bundles/path={x}")
    for x in versions.listed(spark, f"{folder}/manifests"):
        if x not in manifests:
            versions.delete(spark, f"{folder}/manifests/{x}")
    return len(gone)


def read_build(spark: SparkSession, folder: str, entry: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, entries, bundles) of the build that counts; ``entry`` is the schema of the manifest's entries."""
    _, state = versions.current(spark, folder)
    header, entries = b.read_manifest(spark, f"{folder}/manifests/{state['manifest']}", entry)
    return header, entries, b.read_bundles(spark, [f"{folder}/bundles/path={x}" for x in state["bundles"]], f"{folder}/bundles")
