"""HTML of one document to rows, with the standard library's tokenizer. No tree is built: events carry the open tags that
the extraction jobs ask about. Unclosed cells, rows, items and paragraphs end where the next one starts."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset({"script", "style", "template", "noscript"})
_ENDS = {
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "option": {"option"}
}
_SCOPES = {
    "td": "table", "th": "table", "tr": "table", "li": ("ul", "ol", "menu"), "dt": "dl", "dd": "dl",
    "p": ("div", "td", "article", "section")
}
_LEVELS = {f"h{i}": i for i in range(1, 7)}


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Reader(HTMLParser):
    """Collects elements of the wanted tags in document order: tag, attributes, text inside, and the open tags around."""

    def __init__(self, wanted: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.found, self.silent = wanted, [], [], 0
        self.live: list[dict] = []  # open elements whose text is wanted

    def handle_starttag(self, tag, attrs):
        if ends := _ENDS.get(tag):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] in _SCOPES.get(tag, ()):
                    break
                if self.open[i]["tag"] in ends:
                    self.cut(i)
                    break
        if tag in self.wanted:
            node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": [], "parents": tuple(self.open), "pos": len(self.found)}
            self.found.append(node)
            if tag not in _VOID:
                self.live.append(node)
        else:
            node = {"tag": tag, "attrs": dict(attrs)}
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        self.open.append(node)
        self.silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                self.cut(i)
                break

    def cut(self, i):
        """Elements from the i-th on are closed."""
        gone = self.open[i:]
        del self.open[i:]
        self.silent -= sum(x["tag"] in _SILENT for x in gone)
        wanted = sum(x["tag"] in self.wanted for x in gone)
        if wanted:
            del self.live[-wanted:]

    def handle_data(self, data):
        if not self.silent:
            for node in self.live:
                node["text"].append(data)


def elements(body: str | None, *tags: str) -> list[dict]:
    reader = _Reader(frozenset(tags))
    reader.feed(body or "")
    reader.close()
    return reader.found


def _of(found: list[dict], *tags: str) -> list[dict]:
    """The elements of some tags, as if only these had been asked for."""
    return [n for n in found if n["tag"] in tags]


def links_of(found: list[dict]) -> list[dict]:
    """Every link with text."""
    out = [(n["attrs"]["href"], squeeze("".join(n["text"]))) for n in _of(found, "a") if "href" in n["attrs"]]
    return [{"pos": i, "href": h, "text": t} for i, (h, t) in enumerate(x for x in out if x[1])]


def headings_of(found: list[dict]) -> list[dict]:
    """h1 to h6 with an id; section is the latest level-1 text up to it."""
    section, out = None, []
    for i, n in enumerate(_of(found, *_LEVELS)):
        if n["attrs"].get("id"):
            text = squeeze("".join(n["text"]))
            section = text if n["tag"] == "h1" else section
            out.append({"pos": i, "level": _LEVELS[n["tag"]], "id": n["attrs"]["id"], "text": text, "section": section})
    return out


def clauses_of(found: list[dict], tags: tuple[str, ...]) -> list[dict]:
    """Elements of the tags that have an id and a heading as a direct child."""
    own, out = _of(found, *tags, *_LEVELS), {}
    place = {id(n): i for i, n in enumerate(own)}
    for n in own:
        if n["tag"] in _LEVELS and n["parents"] and (p := n["parents"][-1])["tag"] in tags and p["attrs"].get("id"):
            at = place[id(p)]
            out.setdefault(at, {"pos": at, "id": p["attrs"]["id"], "text": squeeze("".join(n["text"]))})
    return [out[k] for k in sorted(out) if out[k]["text"]]


def table_rows_of(found: list[dict], min_cells: int) -> list[dict]:
    """Rows with so many data cells or more: of each its text, first link and the texts of its spans."""
    rows: dict[int, list[dict]] = {}
    cell_of: dict[int, dict] = {}
    for n in _of(found, "tr", "td", "a", "span"):
        near = next((p for p in reversed(n["parents"]) if p["tag"] in ("td", "tr")), None)
        if n["tag"] == "td" and near and near["tag"] == "tr":
            cell_of[n["pos"]] = cell = {"node": n, "href": None, "spans": []}
            rows.setdefault(near["pos"], []).append(cell)
        elif n["tag"] in ("a", "span") and near and near["pos"] in cell_of:
            cell = cell_of[near["pos"]]
            if n["tag"] == "span":
                cell["spans"].append(squeeze("".join(n["text"])))
            elif cell["href"] is None:
                cell["href"] = n["attrs"].get("href")
    kept = [[{"text": squeeze("".join(c["node"]["text"])), "href": c["href"], "spans": c["spans"]} for c in rows[k]] for k in sorted(rows)]
    return [{"pos": i, "cells": c} for i, c in enumerate(x for x in kept if len(x) >= min_cells)]


def subtree_links_of(found: list[dict], marker: str) -> list[dict]:
    """Links in the nearest list item around the first link to ``marker``."""
    own = [n for n in _of(found, "a") if "href" in n["attrs"]]
    top = next((next((p for p in reversed(n["parents"]) if p["tag"] == "li"), None) for n in own if n["attrs"]["href"] == marker), None)
    inside = [n for n in own if top is not None and any(p is top for p in n["parents"])]
    out = [(n["attrs"]["href"], squeeze("".join(n["text"]))) for n in inside]
    return [{"pos": i, "href": h, "text": t} for i, (h, t) in enumerate(x for x in out if x[1])]


def toc_parts_of(found: list[dict], list_class: str, part_class: str) -> list[dict]:
    """Chapter links under lists of a class, with the title of the latest item of the part class."""
    part, out = None, []
    for n in _of(found, "a", "li"):
        classes = n["attrs"].get("class", "").split()
        if n["tag"] == "li" and part_class in classes:
            part = squeeze("".join(n["text"]))
        elif n["tag"] == "a" and "href" in n["attrs"] and any(list_class in (p["attrs"].get("class") or "").split() for p in n["parents"]):
            text = re.sub(r"^\d+(?:\.\d+)*\.?\s+", "", squeeze("".join(n["text"])))
            out.append({"pos": len(out), "href": n["attrs"]["href"], "text": text, "part": part})
    return out


#: Of each job the tags that it looks at, of its parameters, and what it makes of their elements.
JOBS = {
    "links": (lambda: ("a",), links_of),
    "headings": (lambda: tuple(_LEVELS), headings_of),
    "clauses": (lambda tags: (*tags, *_LEVELS), clauses_of),
    "table_rows": (lambda min_cells: ("tr", "td", "a", "span"), table_rows_of),
    "subtree_links": (lambda marker: ("a", "li"), subtree_links_of),
    "toc_parts": (lambda list_class, part_class: ("a", "li"), toc_parts_of),
}


def run(body: str | None, jobs: dict[str, tuple[str, dict]]) -> dict[str, list[dict]]:
    """The rows of several jobs (name: kind and parameters), from one pass over the body."""
    found = elements(body, *{tag for kind, options in jobs.values() for tag in JOBS[kind][0](**options)})
    return {name: JOBS[kind][1](found, **options) for name, (kind, options) in jobs.items()}


def one(body: str | None, kind: str, **options) -> list[dict]:
    return run(body, {kind: (kind, options)})[kind]


def plain(body: str | None) -> str | None:
    if body is None:
        return None
    return squeeze("".join("".join(n["text"]) for n in elements(f"<body-text>{body}</body-text>", "body-text"))).replace(" --- ", " — ")


@F.pandas_udf(StringType())
def plain_html_text(fragments: pd.Series) -> pd.Series:
    """Text of HTML fragments, `` --- `` as a dash, white space collapsed."""
    return fragments.map(plain)
