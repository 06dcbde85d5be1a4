"""Extraction jobs: raw documents (doc_id, url, body) to links and records.

The rules of a site (prefix, scope, exclusions, slugs) are parameters. Text shapes (sitemap, feed, JSON, Markdown) are column
expressions; HTML and nested tables of contents go through Arrow batches, one document at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w
from pyspark.sql.types import StructType

from ..functions import html as h
from ..functions import outline
from ..functions.text import collapse, decode_entities, plain_markdown
from ..functions.urls import fragment_encoded, humanize_slug, path_segments, percent_decoded, slug_from_url, url_parts, url_resolve

_LINK = "pos int, href string, text string"


#: Documents whose rows leave a Python worker together.
TOGETHER = 64

# What the formats write. Locations of a sitemap; items of a feed; identifiers of papers; release numbers;
# stage headings of a proposals list; reference definitions of Markdown.
SITEMAP_LOCATION = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
FEED_ITEM = r"(?is)<item\b[^>]*>(.*?)</item>"
PAPER_IDENTIFIER = r"^P\d{4}R\d+$"
RELEASE = r"^\d+\.\d+\.\d+$"
STAGE_HEADING = r"(?i)^###\s+Stage\s+([0-9.]+)"
DEFINITION = r"^\s*\[([^\]]+)\]:\s*(\S+)"


def _columns(schema: str) -> list[str]:
    """The columns of a schema text, each with its type."""
    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields]


def _mapped(df: DataFrame, run: Callable[[str | None], list[dict]], schema: str, columns: Iterable[str] = ("doc_id", "url")) -> DataFrame:
    """One row for each item that ``run`` finds in a body, with the document's columns. Rows leave for some documents at a
    time, so memory holds one batch of bodies and the rows of these."""
    keep = [c for c in columns if c in df.columns]
    fields = [c.split(" ")[0] for c in _columns(schema)]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), TOGETHER):
                out: dict[str, list] = {c: [] for c in [*keep, *fields]}
                for row in part.iloc[at : at + TOGETHER].itertuples(index=False):
                    found = run(row[-1])
                    for i, c in enumerate(keep):
                        out[c] += [row[i]] * len(found)
                    for f in fields:
                        out[f] += [x.get(f) for x in found]
                if out[fields[0]]:
                    yield pd.DataFrame(out, dtype=object)  # numbers may be missing

    held = df.select(*keep, "body")
    return held.mapInPandas(batches, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]), schema]))


#: Columns of the jobs that read HTML.
COLUMNS = {
    "links": _LINK, "subtree_links": _LINK, "toc_parts": _LINK + ", part string",
    "headings": "pos int, level int, id string, text string, section string", "clauses": "pos int, id string, text string",
    "table_rows": "pos int, cells array<struct<text:string,href:string,spans:array<string>>>",
}


def _job(df: DataFrame, kind: str, **options) -> DataFrame:
    return _mapped(df, lambda body: h.one(body, kind, **options), COLUMNS[kind])


def _anchored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("link", F.concat("url", F.lit("#"), fragment_encoded(F.col("id"))))


def extract_all(df: DataFrame, jobs: dict[str, tuple[str, dict]]) -> DataFrame:
    """The rows of several HTML jobs (name: kind and parameters), each body read once: doc_id, url, job, and the columns of all
    kinds. ``job_rows`` gives those of one, as the job alone would."""
    every = dict.fromkeys(c for kind, _ in jobs.values() for c in _columns(COLUMNS[kind]))

    def run(body: str | None) -> list[dict]:
        return [{"job": name, **row} for name, rows in h.run(body, jobs).items() for row in rows]

    return _mapped(df, run, "job string, " + ", ".join(every))


def job_rows(rows: DataFrame, name: str, kind: str) -> DataFrame:
    """The rows of one job of ``extract_all``, as its own function returns them."""
    fields = [c.split(" ")[0] for c in _columns(COLUMNS[kind])]
    keep = [c for c in ("doc_id", "url") if c in rows.columns]
    out = rows.where(F.col("job") == name).select(*keep, *fields)
    return _anchored(out) if kind in ("headings", "clauses") else out


# Links -----------------------------------------------------------------------------------------------------------


def extract_html_links(df: DataFrame) -> DataFrame:
    """(doc_id, url, pos, href, text) of every link with text."""
    return _job(df, "links")


def first_per_url(links: DataFrame, keys: Iterable[str] = ("doc_id",), prefer_last: bool = False) -> DataFrame:
    """One row for each link URL of a document, the first or last."""
    keys = list(keys)
    rest = [c for c in links.columns if c not in [*keys, "link"]]
    pick = F.max_by if prefer_last else F.min_by
    return links.groupBy(*keys, "link").agg(pick(F.struct(*rest), "pos").alias("one")).select(*keys, "link", "one.*").select(*links.columns)


def link_records(links: DataFrame, base: Column | str | None = None, prefix: str = "") -> DataFrame:
    """Links resolved against the base (the document's URL unless given) that start with the prefix, first per URL, as column
    ``link``."""
    base = F.col("url") if base is None else F.lit(base) if isinstance(base, str) else base
    return first_per_url(links.withColumn("link", url_resolve(base, F.col("href"))).where(F.startswith("link", F.lit(prefix))))


def scoped_links(
    links: DataFrame, root: str, https: bool = True, bare: bool = True, exclude: Iterable[str] = (), suffix: str | None = None,
    prefer_last: bool = False
) -> DataFrame:
    """Resolved links within a path: same host, path equal to the root's or under it, and further rules."""
    at, parts = re.match(r"^(https?)://([^/]+)(.*?)/?$", root), url_parts(F.col("link"))
    rule = (parts["host"] == at[2].lower()) & ((parts["path"] == (at[3] or "/")) | F.startswith(parts["path"], F.lit(at[3] + "/")))
    rule = rule & (parts["protocol"] == "https") if https else rule
    rule = rule & (parts["query"] == "") & (parts["fragment"] == "") if bare else rule
    rule = rule & ~parts["path"].isin(*exclude) if (exclude := list(exclude)) else rule
    rule = rule & F.endswith(parts["path"], F.lit(suffix)) if suffix else rule
    return first_per_url(links.withColumn("link", url_resolve(F.col("url"), F.col("href"))).where(rule), prefer_last=prefer_last)


def discover_partitions(links: DataFrame, pattern: str) -> DataFrame:
    """Distinct follow-up index URLs (link), without query and fragment, whose path matches, in order."""
    parts = url_parts(F.col("link"))
    rows = links.withColumn("link", url_resolve(F.col("url"), F.col("href"))).where(F.rlike(parts["path"], F.lit(pattern)))
    return rows.select(F.regexp_replace("link", r"[?#].*$", "").alias("link")).distinct().orderBy("link")


def discover_script(df: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    """(doc_id, link, sound) of the first script element of a page, in the order of the page, whose file name matches; ``sound``
    is whether the page has one and it is under ``scope``, the page's own URL unless given."""
    # A value in either quotes: one of the two groups is empty.
    source = r"""(?is)<script\b(?:[^>"']|"[^"]*"|'[^']*')*?\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    either = F.zip_with(
        F.regexp_extract_all("body", F.lit(source), F.lit(1)), F.regexp_extract_all("body", F.lit(source), F.lit(2)), lambda a, b: F.concat(a, b)
    )
    first = F.get(F.filter(either, lambda x: F.rlike(F.substring_index(x, "/", -1), F.lit(name))), F.lit(0))
    under = F.col("url") if scope is None else F.lit(scope)
    found = df.select("doc_id", under.alias("under"), F.when(first.isNotNull(), url_resolve(F.col("url"), first)).alias("link"))
    return found.select("doc_id", "link", F.coalesce(F.startswith("link", "under"), F.lit(False)).alias("sound"))


def subtree_links(df: DataFrame, marker: str) -> DataFrame:
    return _job(df, "subtree_links", marker=marker)


def toc_parts(df: DataFrame, list_class: str, part_class: str) -> DataFrame:
    return _job(df, "toc_parts", list_class=list_class, part_class=part_class)


# Headings, clauses, tables ---------------------------------------------------------------------------------------


def extract_html_headings(df: DataFrame) -> DataFrame:
    """(doc_id, url, pos, level, id, text, section, link): headings with an id; section is the latest level-1 text up to it."""
    return _anchored(_job(df, "headings"))


def extract_clauses(df: DataFrame, tags: tuple[str, ...] = ("emu-intro", "emu-clause", "emu-annex")) -> DataFrame:
    return _anchored(_job(df, "clauses", tags=tags))


def extract_table_rows(df: DataFrame, min_cells: int = 8) -> DataFrame:
    """(doc_id, url, pos, cells) of table rows with so many data cells."""
    return _job(df, "table_rows", min_cells=min_cells)


def paper_rows(rows: DataFrame, identifier: str = PAPER_IDENTIFIER) -> DataFrame:
    """Typed columns of table rows: identifier, title, author, date, group, status, link."""
    cell = lambda i: F.get("cells", F.lit(i))
    name = F.upper(cell(0)["text"])
    return rows.where(F.rlike(name, F.lit(identifier)) & cell(0)["href"].isNotNull() & (cell(1)["text"] != "")).select(
        "doc_id", F.col("url").alias("page_url"), "pos", name.alias("identifier"), cell(1)["text"].alias("title"),
        cell(2)["text"].alias("author"), cell(3)["text"].alias("date"), cell(6)["text"].alias("group"), cell(7)["text"].alias("status"),
        url_resolve(F.col("url"), cell(0)["href"]).alias("link")
    )


# Sitemaps and feeds ----------------------------------------------------------------------------------------------


def extract_sitemap(df: DataFrame, prefixes: Iterable[str], fallback_title: str = "Documentation") -> DataFrame:
    """(doc_id, pos, link, title) of the locations under the prefixes; the title comes from the slug."""
    found = df.select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(SITEMAP_LOCATION), F.lit(1))).alias("pos", "raw"))
    rows = found.select("doc_id", "pos", decode_entities(F.col("raw")).alias("link"))
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | F.startswith("link", F.lit(p))
    return rows.where(inside).withColumn("title", slug_from_url(F.col("link"), fallback_title))


def extract_rss(df: DataFrame, prefix: str = "") -> DataFrame:
    """(doc_id, pos, title, link) of a feed's items with a title and a link under the prefix."""
    items = df.select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(FEED_ITEM), F.lit(1))).alias("pos", "item"))
    text = lambda tag: collapse(
        decode_entities(F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), numeric=True, cdata=True)
    )
    return items.select("doc_id", "pos", text("title").alias("title"), text("link").alias("link")).where(
        (F.col("title") != "") & (F.col("link") != "") & F.startswith("link", F.lit(prefix))
    )


def slug_kind_records(links: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Titles of links by their last segment: if that ends in a known ``_kind``, the rest in upper case joined by `` / `` and the
    kind as section, else the humanized segment."""
    slug = F.regexp_replace(
        percent_decoded(F.coalesce(F.try_element_at(path_segments(F.col("link")), F.lit(-1)), F.lit(""))), r"\.html$", ""
    )
    kind = F.get(F.filter(F.array(*(F.lit(k) for k in kinds)), lambda k: F.endswith(slug, F.concat(F.lit("_"), k))), F.lit(0))
    names = F.filter(F.split(F.left(slug, F.length(slug) - F.length(kind) - 1), "_"), lambda s: s != "")
    title = F.when(kind.isNotNull(), F.array_join(F.transform(names, lambda s: F.upper(s)), " / ")).otherwise(humanize_slug(slug))
    return links.where(slug != "").withColumns({"title": title, "section": humanize_slug(kind)})


# JSON ------------------------------------------------------------------------------------------------------------


def unwrapped(c: Column) -> Column:
    """The outermost ``{...}`` of a script that assigns or passes JSON."""
    start, end = F.locate("{", c), F.length(c) - F.locate("}", F.reverse(c)) + 1
    return F.when(start > 0, F.substring(c, start, end - start + 1))


def _tree(body: str | None, form: str):
    """(tree, None), or (None, why the body can't be read)."""
    try:
        return outline.read(body or "") if form == "yaml" else json.loads(body or "null"), None
    except ValueError as e:
        return None, str(e)


def unreadable_toc(df: DataFrame, form: str = "json") -> DataFrame:
    """(doc_id, url, reason) of tables of contents that can't be read."""
    reason = lambda body: [{"reason": why} for _, why in [_tree(body, form)] if why]
    return _mapped(df, reason, "reason string")


def flatten_toc(
    df: DataFrame, children: str = "children", title: str = "title", path: str = "path", marker: str = "groupMarker",
    roots: str | None = None, form: str = "json",
) -> DataFrame:
    """(doc_id, url, pos, title, path, section) of a nested table of contents of any depth, JSON or the YAML of outlines. Section
    is the latest group marker among the siblings, else the nearest titled ancestor. What can't be read has no rows here, and one
    of ``unreadable_toc``."""

    def walk(body: str | None) -> list[dict]:
        tree, _ = _tree(body, form)
        top = tree.get(roots) if roots and isinstance(tree, dict) else tree
        if isinstance(top, dict):
            top = [x for v in top.values() for x in (v if isinstance(v, list) else [v])] if roots else [top]
        out: list[dict] = []
        stack = [(iter(top or []), None, None)]
        while stack:
            items, group, ancestor = stack.pop()
            for item in items:
                if not isinstance(item, dict):
                    continue
                name = str(item.get(title) or "").strip()
                if item.get("type") == marker and name:
                    group = name
                elif name and isinstance(item.get(path), str):
                    out.append({"pos": len(out), "title": name, "path": item[path], "section": group or ancestor})
                if below := item.get(children):
                    stack.append((items, group, ancestor))
                    stack.append((iter(below), group, name or ancestor))
                    break
        return out

    return _mapped(df, walk, "pos int, title string, path string, section string")


def locale_prefixed(path: Column, locale: str) -> Column:
    """A root-relative path under its locale's folder; others, and those that are there already, stay."""
    inside = F.startswith(path, F.lit(f"/{locale}/"))
    return F.when(F.startswith(path, F.lit("/")) & ~inside, F.concat(F.lit(f"/{locale}"), path)).otherwise(path)


def localized_share(rows: DataFrame, pattern: str = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]") -> DataFrame:
    """(doc_id, share) of titles in the locale's script; a table of contents counts as localized from one half."""
    return rows.groupBy("doc_id").agg(F.avg(F.rlike("title", F.lit(pattern)).cast("int")).alias("share"))


def flatten_sidebar(df: DataFrame) -> DataFrame:
    """(doc_id, title, page, anchor, section) of a sidebar assigned to a script variable: pages of modules, extras and tasks,
    their headers, and the nodes of their groups."""
    node = "struct<id:string,title:string,anchor:string>"
    group = f"struct<key:string,name:string,nodes:array<{node}>>"
    page = f"struct<id:string,title:string,group:string,headers:array<struct<id:string,anchor:string>>,nodeGroups:array<{group}>>"
    parsed = df.select(
        "doc_id", F.from_json(unwrapped(F.col("body")), f"modules array<{page}>, extras array<{page}>, tasks array<{page}>").alias("s")
    )
    none = F.array().cast(f"array<{page}>")
    pages = parsed.select(
        "doc_id", F.posexplode(F.concat(*(F.coalesce(f"s.{k}", none) for k in ("modules", "extras", "tasks")))).alias("pos", "p")
    )
    top = pages.select(
        "doc_id", "pos", F.col("p.title").alias("title"), F.col("p.id").alias("page"), F.lit(None).cast("string").alias("anchor"),
        F.nullif("p.group", F.lit("")).alias("section")
    )
    heads = pages.select("doc_id", "pos", "p", F.explode("p.headers").alias("x")).select(
        "doc_id", "pos", F.col("x.id").alias("title"), F.col("p.id").alias("page"), F.col("x.anchor").alias("anchor"),
        F.col("p.title").alias("section")
    )
    nodes = pages.select("doc_id", "pos", "p", F.explode("p.nodeGroups").alias("g")).select("doc_id", "pos", "p", F.explode("g.nodes").alias("x")).select(
        "doc_id", "pos", F.coalesce("x.title", "x.id").alias("title"), F.col("p.id").alias("page"), F.col("x.anchor").alias("anchor"),
        F.col("p.title").alias("section")
    )
    return top.unionByName(heads).unionByName(nodes).where("title is not null and title <> ''")


def sphinx_records(df: DataFrame, base: str = "") -> DataFrame:
    """(doc_id, kind, title, link, section): pages of a search index and the headings under them."""
    parsed = df.select(
        "doc_id",
        F.from_json(
            unwrapped(F.col("body")), "docnames array<string>, titles array<string>, alltitles map<string,array<array<string>>>"
        ).alias("s")
    )
    pages = parsed.select(
        "doc_id", F.posexplode(F.arrays_zip(F.col("s.docnames").alias("name"), F.col("s.titles").alias("title"))).alias("at", "p")
    ).select("doc_id", "at", "p.name", h.plain_html_text("p.title").alias("title")).where("name is not null and title is not null")
    url = F.concat(
        F.lit(base), F.regexp_replace(F.col("name"), r"(^|/)index$", "$1"),
        F.when(F.rlike("name", F.lit("(^|/)index$")), "").otherwise(".html")
    )
    pages = pages.withColumn("link", url)
    found = parsed.select(
        "doc_id", F.explode("s.alltitles").alias("heading", "places")
    ).select("doc_id", "heading", F.explode("places").alias("place"))
    heads = found.select(
        "doc_id", h.plain_html_text("heading").alias("heading"), F.get("place", F.lit(0)).try_cast("int").alias("at"),
        F.get("place", F.lit(1)).alias("fragment")
    ).where("fragment is not null")
    under = heads.join(pages, ["doc_id", "at"]).select(
        "doc_id", F.lit("heading").alias("kind"), F.col("heading").alias("title"), F.concat("link", F.lit("#"), "fragment").alias("link"),
        F.col("title").alias("section")
    )
    return pages.select(
        "doc_id", F.lit("page").alias("kind"), "title", "link", F.lit(None).cast("string").alias("section")
    ).unionByName(under)


def javadoc_records(packages: DataFrame, types: DataFrame, base: str = "") -> DataFrame:
    """(kind, title, link, section): packages, and types joined to the module of their package. The last of a repeated package
    counts; types without one are dropped."""
    parsed = lambda df, s: df.select(
        F.posexplode(F.from_json(F.regexp_extract("body", r"(?s)(\[.*\])", 1), f"array<struct<{s}>>")).alias("pos", "x")
    ).select("pos", "x.*")
    p = parsed(packages, "l:string,m:string").where("l is not null").groupBy("l").agg(F.max_by("m", "pos").alias("m"))
    t = parsed(types, "p:string,l:string").where("l is not null")
    folder = F.concat(
        F.when(F.coalesce("m", F.lit("")) != "", F.concat("m", F.lit("/"))).otherwise(""),
        F.replace(F.col("package"), F.lit("."), F.lit("/"))
    )
    of_packages = p.select(
        F.lit("package").alias("kind"), F.col("l").alias("title"), F.col("l").alias("package"), "m"
    ).withColumn("link", F.concat(F.lit(base), folder, F.lit("/package-summary.html")))
    of_types = t.select(F.col("p").alias("package"), F.col("l").alias("title")).join(p.withColumnRenamed("l", "package"), "package").withColumn("kind", F.lit("type")).withColumn(
        "link", F.concat(F.lit(base), folder, F.lit("/"), "title", F.lit(".html"))
    )
    return of_packages.select("kind", "title", "link", F.col("m").alias("section")).unionByName(
        of_types.select("kind", "title", "link", F.col("package").alias("section"))
    )


def json_entry_records(
    df: DataFrame, entry: str, title: Callable[[Column], Column], link: Callable[[Column], Column],
    section: Callable[[Column], Column] | None = None, field: str | None = None, accept: Callable[[Column], Column] | None = None,
    mapped: bool = False
) -> DataFrame:
    """(doc_id, pos, title, link, section) of a flat JSON list (or the values of a map) of ``entry`` structs, in a field or at
    the top. The callables take the entry's column, so a site's rules stay expressions."""
    shape = f"map<string,struct<{entry}>>" if mapped else f"array<struct<{entry}>>"
    items = F.from_json("body", f"`{field}` {shape}")[field] if field else F.from_json("body", shape)
    items = F.map_values(items) if mapped else items
    rows = df.select("doc_id", F.posexplode(items).alias("pos", "x"))
    rows = rows.select(
        "doc_id", "pos", "x", title(F.col("x")).alias("title"), link(F.col("x")).alias("link"),
        (section(F.col("x")) if section else F.lit(None).cast("string")).alias("section")
    )
    ok = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")
    return rows.where(ok & accept(F.col("x")) if accept else ok).drop("x")


def latest_version_records(df: DataFrame, pattern: str = RELEASE) -> DataFrame:
    """(doc_id, name, version): the last of each name's versions, where it is a plain release."""
    rows = df.select("doc_id", F.explode(F.from_json("body", "map<string,array<string>>")).alias("name", "versions"))
    return rows.select("doc_id", "name", F.try_element_at("versions", F.lit(-1)).alias("version")).where(F.rlike("version", F.lit(pattern)))


def json_path_lists(df: DataFrame, pattern: str = r"^[A-Za-z0-9._/-]+$") -> DataFrame:
    """(doc_id, path, title, section) of a map from keyword to paths: title from the last segment, section from the first."""
    rows = df.select(
        "doc_id", F.explode(F.array_distinct(F.flatten(F.map_values(F.from_json("body", "map<string,array<string>>"))))).alias("path")
    )
    parts = F.split("path", "/")
    return rows.where(F.rlike("path", F.lit(pattern)) & ~F.contains("path", F.lit(".."))).select(
        "doc_id", "path", humanize_slug(F.regexp_replace(F.element_at(parts, -1), r"\.[a-z]+$", "")).alias("title"),
        F.when(F.size(parts) > 1, humanize_slug(F.get(parts, F.lit(0)))).alias("section")
    )


# Markdown --------------------------------------------------------------------------------------------------------
# A document is one row, so what its lines say about later lines is found in the array of its lines, without a shuffle.


def _marked_lines(df: DataFrame, row: Callable[[Column], Column], name: str, mark: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, pos, line, ``name``) of the lines that ``row`` accepts; ``name`` is the latest value of the mark up to the line, or
    null. A mark gives a line's value, or null. A document is cut into the stretches that its marked lines begin, so each line
    is looked at once and carries one value, not all of the document's."""
    lines = F.transform(F.split("body", r"\r?\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"), mark(x).alias("value")))
    rows = df.select("doc_id", lines.alias("lines"))
    marked = F.transform(F.filter("lines", lambda x: x["value"].isNotNull()), lambda x: x["pos"])
    rows = rows.select("doc_id", "lines", F.concat(F.array(F.lit(0)), marked, F.array(F.size("lines"))).alias("edges"))
    # Each stretch carries its own lines only.
    part = lambda k: F.slice("lines", F.get("edges", k) + 1, F.get("edges", k + 1) - F.get("edges", k))
    parts = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), part)).alias("part"))
    parts = parts.select("doc_id", F.get("part", F.lit(0))["value"].alias(name), F.filter("part", lambda x: row(x["line"])).alias("part"))
    found = parts.select("doc_id", name, F.explode("part").alias("x"))
    return found.select("doc_id", "x.pos", "x.line", name)


def _title_of(pattern: str, group: int = 1) -> Callable[[Column], Column]:
    return lambda line: F.when(F.rlike(line, F.lit(pattern)), plain_markdown(F.regexp_extract(line, pattern, group)))


def markdown_links(df: DataFrame) -> DataFrame:
    """(doc_id, pos, depth, title, href, section) of lines that begin with a list mark and a link, or are nothing but a link;
    section is the latest ``#`` heading."""
    link = r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)"
    item, alone = rf"^(\s*)[-*+]\s+{link}", rf"^(\s*){link}\s*$"
    rows = _marked_lines(df, lambda x: F.rlike(x, F.lit(item)) | F.rlike(x, F.lit(alone)), "section", _title_of(r"^#{1,6}\s+(.*?)\s*#*\s*$"))
    of = lambda i: F.when(
        F.rlike("line", F.lit(item)), F.regexp_extract("line", item, i)
    ).otherwise(F.regexp_extract("line", alone, i))
    return rows.select(
        "doc_id", "pos", F.length(of(1)).alias("depth"), plain_markdown(of(2)).alias("title"), of(3).alias("href"),
        F.nullif("section", F.lit("")).alias("section")
    )


def markdown_inline_links(df: DataFrame, pattern: str = "") -> DataFrame:
    """(doc_id, pos, title, href) of every link in running text whose target matches; pos counts links, images are none."""
    link = r"(?<!!)\[([^\]\n]+)\]\(([^)\s]+)[^)\n]*\)"
    both = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(link), F.lit(1)).alias("title"),
        F.regexp_extract_all("body", F.lit(link), F.lit(2)).alias("href")
    )
    rows = df.select("doc_id", F.posexplode(both).alias("pos", "x")).where(F.rlike("x.href", F.lit(pattern)))
    return rows.select("doc_id", "pos", plain_markdown(F.col("x.title")).alias("title"), "x.href")


def markdown_anchored_headings(df: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, anchor, section): ``# <a name=...></a> title`` lines; section is the latest level-1 title."""
    pattern = r"""^(#{1,6})\s*<a\s+(?:name|id)=["']?([^"'>\s]+)["']?\s*>\s*</a>\s*(.*?)\s*#*\s*$"""
    rows = _marked_lines(df, lambda x: F.rlike(x, F.lit(pattern)), "section", _title_of(pattern.replace("{1,6}", "{1}(?!#)"), 3))
    level = F.length(F.regexp_extract("line", pattern, 1))
    return rows.select(
        "doc_id", "pos", level.alias("level"), plain_markdown(F.regexp_extract("line", pattern, 3)).alias("title"),
        F.regexp_extract("line", pattern, 2).alias("anchor"), "section"
    )


def zip_summary_with_sitemap(summary: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(doc_id, title, link, section, sound): the i-th summary entry (doc_id, pos, depth, title) gets the (i+1)-th location
    (doc_id, pos, link). ``sound`` is whether there is one location more than entries; section is the latest top title. A
    summary is one document's, so its entries meet in one place."""
    of_doc = w.Window.partitionBy("doc_id")
    place = of_doc.orderBy("pos")
    top = F.last(F.when(F.col("depth") == 0, F.col("title")), ignorenulls=True).over(place)
    a = summary.withColumns({"i": F.row_number().over(place), "n": F.count("*").over(of_doc), "section": top})
    b = sitemap.withColumns({"i": F.row_number().over(place) - 1, "m": F.count("*").over(of_doc)}).select("doc_id", "i", "m", "link")
    sound = F.coalesce(F.max("m").over(of_doc) == F.col("n") + 1, F.lit(False))
    return a.join(b, ["doc_id", "i"], "left").select("doc_id", "title", "link", "section", sound.alias("sound"))


def markdown_status_tables(df: DataFrame, default_status: str = "") -> DataFrame:
    """(doc_id, pos, title, link, status) of pipe tables' rows. Status is the latest stage heading or the default, with an
    ``inactive`` reason from the last cell; reference links resolve through the document's definitions, the last of a label,
    and a link without any is the document and line."""
    lines = F.split("body", r"\r?\n")
    defined = F.transform(
        F.filter(lines, lambda x: F.rlike(x, F.lit(DEFINITION))),
        lambda x: F.struct(F.lower(F.regexp_extract(x, DEFINITION, 1)).alias("label"), F.regexp_extract(x, DEFINITION, 2).alias("target"))
    )
    table = lambda x: F.rlike(x, F.lit(r"^\s*\|.*\|\s*$")) & ~F.rlike(x, F.lit(r"^\s*\|[\s:|-]+\|\s*$"))
    stage = lambda x: F.when(
        F.rlike(x, F.lit(STAGE_HEADING)), F.concat(F.lit("stage-"), F.regexp_extract(x, STAGE_HEADING, 1))
    )
    rows = _marked_lines(df.select(F.struct("doc_id", defined.alias("defined")).alias("doc_id"), "body"), table, "status", stage)
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    rows = rows.select(
        "doc_id.doc_id", "doc_id.defined", "pos", F.coalesce("status", F.lit(default_status)).alias("status"), cells.alias("cells")
    ).withColumn("first", F.get("cells", F.lit(0)))
    direct = F.nullif(F.regexp_extract("first", r"\[[^\]]*\]\(([^)\s]+)", 1), F.lit(""))
    label = F.lower(
        F.coalesce(
            F.nullif(F.regexp_extract("first", r"\[[^\]]*\]\[([^\]]+)\]", 1), F.lit("")), F.regexp_extract("first", r"\[([^\]]+)\]", 1)
        )
    )
    rows = rows.where(F.contains("first", F.lit("["))).withColumns({"direct": direct, "label": label})
    target = F.try_element_at(F.filter("defined", lambda x: x["label"] == F.col("label")), F.lit(-1))["target"]
    link = F.coalesce("direct", target, F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("pos").cast("string")))
    reason = plain_markdown(F.element_at("cells", -1))
    status = F.when((F.col("status") == "inactive") & (reason != ""), F.concat("status", F.lit(": "), reason)).otherwise(F.col("status"))
    return rows.select("doc_id", "pos", plain_markdown(F.col("first")).alias("title"), link.alias("link"), status.alias("status"))


# Look-ups and gates ----------------------------------------------------------------------------------------------


def heading_anchor_lookup(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``entries`` (path, title, fragment) with missing fragments from the first heading id of the page (path, body), else
    from the title's slug."""
    first = pages.select("path", F.nullif(F.regexp_extract("body", r"""(?is)<h[1-6]\b[^>]*\bid=["']?([^"'\s>]+)""", 1), F.lit("")).alias("_id")).groupBy("path").agg(F.min("_id").alias("_id"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("title")), r"[^\p{L}\p{N}\s-]+", ""), r"\s+", "-")
    return entries.join(first, "path", "left").withColumn(
        "fragment", F.coalesce(F.nullif("fragment", F.lit("")), "_id", slug)
    ).select(*entries.columns)


def assert_edition(df: DataFrame, pattern: str, expected: str) -> DataFrame:
    """Sources (source_id, found) whose pages show another edition than expected, or none."""
    found = F.nullif(F.regexp_extract("body", pattern, 1), F.lit(""))
    return df.select("source_id", found.alias("found")).where(~F.col("found").eqNullSafe(F.lit(expected))).distinct()


def page_title(body: Column) -> Column:
    """Text of the title element."""
    return collapse(decode_entities(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def relative_links(body: Column) -> Column:
    """The paths of root-relative links, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(r'<a href="(/[^"]*)"'), F.lit(1)), percent_decoded)
