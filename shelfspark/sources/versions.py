"""Commits by pointer: data goes to folders of fresh names, and a small numbered file that is created last says what counts.

A reader takes the pointer of the highest number, so it sees a build whole or not at all. Pointers are created without
overwriting, so of two writers that build on the same version the second one fails. Paths may be in any store that Spark reads."""

from __future__ import annotations

import json
import re

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession

POINTER = re.compile(r"v(\d{8})\.json$")


def _place(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, where = _place(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(m[1]) for x in listed(spark, f"{folder}/_versions") if (m := POINTER.match(x))]


def read_version(spark: SparkSession, folder: str, number: int) -> dict:
    """What a pointer says."""
    fs, where = _place(spark, f"{folder}/_versions/v{number:08d}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The number and content of the version that counts."""
    known = versions(spark, folder)
    return (known[-1], read_version(spark, folder, known[-1])) if known else None


def commit(spark: SparkSession, folder: str, content: dict, after: int | None) -> int:
    """Make ``content`` the version that counts, if ``after`` still is."""
    known = versions(spark, folder)
    if (known[-1] if known else None) != after:
        raise RuntimeError(f"{folder} has changed since version {after}")
    number = (after or 0) + 1
    fs, where = _place(spark, f"{folder}/_versions/v{number:08d}.json")
    try:
        stream = fs.create(where, False)
    except CapturedException as e:
        raise RuntimeError(f"{folder} has changed since version {after}") from e
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    return number


def forget(spark: SparkSession, folder: str, keep: int = 2) -> list[dict]:
    """Drop all pointers but the last ``keep``; what those say that stay. Readers of the version before may still be at work."""
    known = versions(spark, folder)
    for number in known[:-keep]:
        delete(spark, f"{folder}/_versions/v{number:08d}.json")
    return [read_version(spark, folder, n) for n in known[-keep:]]
