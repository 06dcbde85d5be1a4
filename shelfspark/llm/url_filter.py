"""Operator 4: URL filters.

Rules ``(verdict, host, path)`` stand in a trie over the reversed host labels and then the path segments. A URL walks down
the trie once; the deepest rule that it meets decides. The trie is broadcast, so its rule count is bounded by
``MOST_RULES``; a larger rule set is joined instead, on the host suffixes and path prefixes of each URL.

Defined results: a null URL, or one without ``://``, has an empty host and path and meets only the default. Hosts compare
after lower-casing A-Z, paths as they are. A rule with an empty path holds for every URL of its host; other rule paths end
with ``/``. Among rules that fit, the one with more host labels wins, then the longer path; a repeated (host, path) with
different verdicts is an error. Rows are independent, repeated ones too; an empty table gives an empty result, and extra
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_free_of, quoted, table

#: Rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: A trie of so many rules (some 100 bytes each) may be sent to every executor.
MOST_RULES = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HERE = ""  # the key of a node's rule; labels and segments are kept with a leading mark, so none is empty


def _steps(host: str, path: str) -> Iterator[str]:
    """A path through the trie: the host labels from the right, then each path segment that a slash closes."""
    for label in reversed(host.split(".")):
        yield "." + label
    if path[:1] == "/":
        yield from ("/" + s for s in path.split("/")[:-1])


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    root: dict = {}
    for verdict, host, path in rules:
        if path and not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"a rule's path is empty or starts and ends with a slash: {path!r}")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {(verdict, host, path)!r}")
        node = root
        for step in _steps(host.lower(), path):
            node = node.setdefault(step, {})
        if node.setdefault(_HERE, (host.lower() + path, verdict)) != (host.lower() + path, verdict):
            raise ValueError(f"{host + path!r} is both allowed and blocked")
    return root


def _find(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """Deepest rule on the way. Each host node may also start paths, so paths are tried from the longest host down."""
    nodes, node = [], trie
    for label in reversed(host.split(".")):
        if (node := node.get("." + label)) is None:
            break
        nodes.append(node)
    for node in reversed(nodes):
        best = node.get(_HERE)
        for step in _steps("", path) if path[:1] == "/" else ():
            if step == ".":
                continue
            if (node := node.get(step)) is None:
                break
            best = node.get(_HERE, best)
        if best:
            return best
    return None, None


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def filter_urls(
    df: DataFrame, url: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", most: int = MOST_RULES
) -> DataFrame:
    """``df`` with host, path, rule (null if none fits) and verdict. Columns of these names are replaced."""
    rules = list(dict.fromkeys(rules))
    trie = build_trie(rules)
    spark = df.sparkSession
    df = df.withColumns({"host": host_of(quoted(url)), "path": path_of(quoted(url))})
    if len(rules) <= most:
        held = spark.sparkContext.broadcast(trie)

        @F.pandas_udf("rule string, verdict string")
        def walk(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(
                [_find(held.value, h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], dtype=object
            )

        own = columns_free_of(df, "found")
        df = df.withColumn(own, walk("host", "path"))
        return df.withColumns({"rule": F.col(f"{own}.rule"), "verdict": F.coalesce(f"{own}.verdict", F.lit(default))}).drop(own)
    return _joined(df, rules, default)


def _joined(df: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same by an equi-join of each distinct (host, path) with the rules on (host suffix, path prefix)."""
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(h.lower(), p, h.lower() + p, v) for v, h, p in rules], "rule_host string, rule_path string, rule string, verdict string"
    )
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    keys = (
        df.select("host", "path").distinct()
        .withColumn(
            "rule_host",
            F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        )
        .withColumn(
            "rule_path",
            F.explode(
                F.concat(
                    F.array(F.lit("")),
                    F.when(
                        F.startswith("path", F.lit("/")),
                        F.transform(
                            F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))
                        )
                    ).otherwise(F.array().cast("array<string>"))
                )
            )
        )
    )
    best = (
        keys.join(known, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"))).alias("won"))
        .select("host", "path", "won.rule", "won.verdict")
    )
    return df.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS n
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON s.page_id IS NOT DISTINCT FROM f.page_id
"""
