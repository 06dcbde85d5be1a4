"""URL functions. Parts of absolute URLs are column expressions; resolving a reference needs the standard library."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that titles write in another way.
NAMES = {"Fsharp": "F#", "Otp": "OTP", "Iex": "IEx", "Ets": "ETS"}


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")
    for i, part in enumerate(parts):
        if part in ("..", "."):
            if part == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def resolve(base: str | None, href: str | None) -> str | None:
    """An absolute http(s) URL with dots and backslashes resolved and the host in lower case; else null."""
    if href is None:
        return None
    try:
        joined = urljoin(base or "", re.sub(r"[\t\n\r]", "", href.strip()).replace("\\", "/"))
        u = urlsplit(joined)
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        port = f":{u.port}" if u.port and u.port != {"http": 80, "https": 443}[u.scheme] else ""
        return urlunsplit(
            (u.scheme, u.hostname.lower() + port, _dots(u.path) or "/", u.query.replace(" ", "%20"), u.fragment.replace(" ", "%20"))
        ).replace(" ", "%20")
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


_ORIGIN = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?=[/?#]|$)"
_SAFE = r"[\p{L}\p{N}_~!$&'()*+,=@%.:-]"
_PLAIN = rf"(?:/{_SAFE}+)*/?(?:\?{_SAFE}+)?(?:#{_SAFE}+)?$"


def url_resolve(base: Column, href: Column) -> Column:
    """An absolute http(s) URL of a reference, or null. Root-relative and absolute references without dots to resolve, and of
    plain characters, stay in the JVM."""
    dots = F.rlike(href, F.lit(r"/\.{1,2}(?:[/?#]|$)"))
    rooted = F.rlike(href, F.lit("^(?=/)" + _PLAIN)) & F.rlike(base, F.lit(_ORIGIN)) & ~dots
    absolute = F.rlike(href, F.lit(_ORIGIN + "(?=/)" + _PLAIN)) & ~dots
    other = ~F.coalesce(rooted, F.lit(False)) & ~F.coalesce(absolute, F.lit(False))
    return F.when(
        rooted, F.concat(F.regexp_extract(base, _ORIGIN, 0), href)
    ).when(absolute, href).otherwise(_resolved(base, F.when(other, href)))


_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?)?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_parts(c: Column) -> dict[str, Column]:
    """protocol, host, path, query and fragment of an absolute URL; empty where it has none."""
    get = lambda i: F.regexp_extract(c, _PARTS, i)
    path = get(3)
    return {
        "protocol": F.lower(get(1)), "host": F.lower(get(2)), "path": F.when(path == "", "/").otherwise(path), "query": get(4),
        "fragment": get(5)
    }


def percent_decoded(c: Column) -> Column:
    """``+`` stays; text that isn't valid stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def spaced(c: Column) -> Column:
    """Dashes, underscores and white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"[-_\s]+", " "))


def humanize_slug(c: Column) -> Column:
    """``a-b_c`` to ``A B C``: spaced, and the first ASCII letter of each word in upper case."""
    starts = F.split(spaced(c), "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(
        F.transform(
            starts,
            lambda w: F.when(
                F.rlike(w, F.lit("^[A-Za-z0-9_]")), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))
            ).otherwise(w)
        ),
        ""
    )


def path_segments(c: Column) -> Column:
    """Non-empty segments of a URL's path."""
    return F.filter(F.split(url_parts(c)["path"], "/"), lambda s: s != "")


def title_from_url(c: Column) -> Column:
    """The last path segment (its parent for an index page) without ``.html``, humanized; empty if there is none."""
    segments = path_segments(c)
    last, parent = F.coalesce(
        F.try_element_at(segments, F.lit(-1)), F.lit("")
    ), F.coalesce(F.get(segments, F.size(segments) - 2), F.lit(""))
    raw = F.when(F.rlike(last, F.lit(r"(?i)^index\.html?$")), parent).otherwise(F.regexp_replace(last, r"(?i)\.html?$", ""))
    title = humanize_slug(percent_decoded(raw))
    for word, name in NAMES.items():
        title = F.regexp_replace(title, rf"\b{word}\b", name)
    return title


def slug_from_url(c: Column, fallback: str = "Documentation") -> Column:
    """As ``title_from_url``, but letters keep their case; the host, or else the fallback, where there is no segment."""
    segments = path_segments(c)
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), url_parts(c)["host"])
    raw = F.when(F.rlike(last, F.lit(r"(?i)^index\.html?$")), F.coalesce(F.get(segments, F.size(segments) - 2), last)).otherwise(last)
    return F.coalesce(F.nullif(spaced(percent_decoded(F.regexp_replace(raw, r"(?i)\.(?:html?|xml)$", ""))), F.lit("")), F.lit(fallback))


def section_from_path(c: Column, i: int) -> Column:
    """The i-th path segment, humanized; null if there is none."""
    return humanize_slug(percent_decoded(F.get(path_segments(c), F.lit(i))))


def title_with_channel(title: Column, url: Column, pattern: str, default: str) -> Column:
    """The title and what the pattern's group finds in the path, or the default."""
    found = F.nullif(F.regexp_extract(url_parts(url)["path"], pattern, 1), F.lit(""))
    return F.concat(title, F.lit(" — "), F.coalesce(found, F.lit(default)))


def fragment_encoded(c: Column) -> Column:
    """Percent-encoding that leaves the marks ``!'()*~`` alone and writes a space as ``%20``."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def build_doc_url(base: str, path: Column, fragment: Column | None = None, suffix: str = ".html") -> Column:
    """base + path with the suffix, without a trailing ``/index``; a ``.md`` ending becomes the suffix. Null for paths that
    are absolute or climb."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.(md|html)$", ""), r"(^|/)index$", "$1")
    url = F.concat(F.lit(base), stem, F.when((stem == "") | F.endswith(stem, F.lit("/")), "").otherwise(suffix))
    if fragment is not None:
        url = F.concat(url, F.when(F.coalesce(fragment, F.lit("")) != "", F.concat(F.lit("#"), fragment_encoded(fragment))).otherwise(""))
    return F.when(~F.rlike(path, F.lit(r"^/|^[a-z]+:|(^|/)\.\.(/|$)")), url)


def versioned_url(url: Column, version: Column) -> Column:
    """``url@version``, unless there is no version."""
    return F.when(F.coalesce(version, F.lit("")) != "", F.concat(url, F.lit("@"), version)).otherwise(url)


def restore_path_case(path: Column, name: Column) -> Column:
    """Path segments that equal a part of the ``::``-separated name but for case get the name's case, the last such part."""
    parts = F.reverse(F.split(name, "::"))
    return F.array_join(
        F.transform(F.split(path, "/"), lambda s: F.coalesce(F.get(F.filter(parts, lambda p: F.lower(p) == s), F.lit(0)), s)), "/"
    )


def canonical_urls(records: DataFrame, moved: DataFrame) -> DataFrame:
    """Known moved URLs (old, new) are replaced; of an old one with several new ones, the first in order counts."""
    names = moved.groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    return records.join(names, F.col("url") == F.col("_old"), "left").withColumn("url", F.coalesce("_new", "url")).drop("_old", "_new")
