"""Extraction, curation, bundles, catalog, refresh and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark import streaming
from shelfspark.operators import extract as x
from shelfspark.operators import records as rec
from shelfspark.operators import refresh as ref
from shelfspark.operators import scope as sc
from shelfspark.sources import bundles as bun
from shelfspark.sources import catalog as cat
from shelfspark.sources import publishing as pub
from shelfspark.sources import versions

TOML = """
[[languages]]
id = "cpp"
name = "C++"
aliases = ["c++", "cplusplus"]
auto_non_official_fallback = true
[[languages.sources]]
id = "cpp-ref"
kind = "community"
name = "Reference"
url = "https://c.example/"
domains = ["c.example"]
path_prefixes = ["/w/"]
site_locales = ["en", "ja"]
qualification_en = "Not official."
qualification_ja = "x"
[[languages.sources.indexes]]
locale = "en"
status = "supported"
[[languages.sources.indexes]]
locale = "ja"
status = "planned"
reason = "later"
[[languages]]
id = "go"
[[languages.sources]]
id = "go-docs"
kind = "odd"
domains = ["https://go.example"]
[[languages.sources]]
id = "go-docs"
"""


def docs(spark, *bodies):
    return spark.createDataFrame([(i, f"https://x.example/d{i}/", b) for i, b in enumerate(bodies)], "doc_id long, url string, body string")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_catalog(spark):
    c = cat.load_catalog(spark, TOML)
    assert rows(c["language_aliases"].select("alias", "language_id").distinct(), "alias", "language_id") == [("cpp", "cpp"), ("go", "go")]
    s = {r.source_pos: r for r in c["sources"].where("language_id = 'go'").collect()}
    assert s[0].source_kind == "official" and s[0].document_kind == "reference" and s[0].source_name == "go-docs" and s[0].default_enabled and s[1].domains == []
    found = {(r.rule, r.id) for r in cat.catalog_integrity(c).collect()}
    assert found == {("duplicate source", "go-docs"), ("no domain", "go-docs"), ("domain is not a host", "go-docs")}
    report = {r.language_id: r for r in cat.coverage_report(c).collect()}
    assert report["cpp"].locales == ["en"] and report["cpp"].pending_reasons == ["later"] and report["go"].indexed_sources == 0
    asked = spark.createDataFrame([(1, ["C++"], "official", True), (2, ["zig"], "all", False), (3, ["cpp", "cplusplus"], "official", False)], "query_id int, languages array<string>, source_mode string, fallback boolean")
    got = rows(sc.resolve_scope(asked, c).select("query_id", "source_id", "automatic").distinct(), "query_id", "source_id")
    assert got == [(1, "cpp-ref", True), (2, "cpp-ref", False), (2, "go-docs", False)]


def test_bundles(spark, tmp_path):
    good = {"schemaVersion": 2, "sourceId": "a", "docsLocale": "en", "urlPrefix": "https://a.example/", "records": [["T", "x"], ["U", "y", "S", "draft"]]}
    cases = {"good": good, "short": good | {"sourceId": "b", "records": [["T"]]}, "blank": good | {"sourceId": "c", "records": [[" ", "x"]]}, "climbs": good | {"sourceId": "d", "urlPrefix": "https://a.example/p/", "records": [["T", "../../x"]]}, "old": good | {"sourceId": "e", "schemaVersion": 1}, "fewer": good | {"sourceId": "f"}, "other": good | {"sourceId": "g"}, "unknown": good | {"sourceId": "h"}}
    for name, body in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    bundles = bun.read_bundles(spark, str(tmp_path))
    manifest = spark.createDataFrame(
        [(b["sourceId"] if n != "other" else "zz", "en", f"{n}.json", len(b["records"]) + (n == "fewer"), "A", "official", None, "go", None, None) for n, b in cases.items() if n != "unknown"],
        "source_id string, docs_locale string, path string, record_count long, source_name string, source_kind string, document_kind string, programming_language string, qualification string, qualification_ja string",
    )
    faults = {r.path: r.reason for r in bun.validate_bundles(bundles, manifest).collect()}
    assert faults == {"short.json": "record", "blank.json": "record", "climbs.json": "url", "old.json": "schema", "fewer.json": "count", "other.json": "identity", "unknown.json": "unknown"}
    sound = bundles.join(bun.validate_bundles(bundles, manifest), "path", "left_anti")
    expanded = bun.expand_bundles(sound, manifest)
    assert rows(expanded.select("pos", "title", "url", "section", "proposal_status", "document_kind"), "pos") == [(0, "T", "https://a.example/x", None, None, "reference"), (1, "U", "https://a.example/y", "S", "draft", "reference")]
    jobs = spark.createDataFrame([("a", "en", "https://a.example/")], "source_id string, docs_locale string, url_prefix string")
    packed = bun.pack_bundles(expanded, jobs).first()
    assert json.loads(packed.body) == good and packed.path == f"a.en.{packed.output_sha256[:16]}.json"
    bun.publish_records(expanded, str(tmp_path / "out"))
    bun.publish_bundles(bun.pack_bundles(expanded, jobs), str(tmp_path / "bundles"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    back = bun.read_bundles(spark, str(tmp_path / "bundles")).first()
    assert back.path == packed.path and back.source_id == "a" and back.records == good["records"]
    entries = spark.createDataFrame([(2, "b", None), (1, "a", 5)], "manifest_pos int, source_id string, record_count long")
    bun.publish_manifest(entries, str(tmp_path / "manifest"), "abc")
    header, rows_back = bun.read_manifest(spark, str(tmp_path / "manifest"), "source_id string, record_count bigint")
    assert rows(header) == [(2, 1, "abc")] and rows(rows_back, "manifest_pos") == [(1, "a", 5), (2, "b", None)]


def test_records(spark):
    schema = "source_id string, docs_locale string, url string, title string, section string, pos long"
    data = [("s", "en", "u1", "B", None, 2), ("s", "en", "u1", "A", None, 1), ("s", "en", "", "x", None, 3), ("s", "en", "u2", None, None, 4), ("s", "ja", "u1", "C", None, 5)]
    df = spark.createDataFrame(data, schema)
    assert rows(rec.unique_records(df).select("docs_locale", "title"), "docs_locale") == [("en", "A"), ("ja", "C")]
    assert rows(rec.combine(df.where("pos = 2"), df.where("pos = 1")).select("title")) == [("B",)]
    ruby = spark.createDataFrame([("r", "ja", "https://r.example/ja/method/Array/i/=3c=3d=3e.html", "x", None, 1), ("r", "en", "https://r.example/en/3.4/A/B.html", "::new", None, 2), ("r", "en", "https://r.example/en/3.4/A/B.html", "new", None, 3)], schema)
    jobs = spark.createDataFrame([("z", "en", "q")], "source_id string, docs_locale string, adapter string")
    assert rows(rec.explicit_titles(ruby, jobs, ruby_sources=["r"]).select("pos", "title"), "pos") == [(1, "Array#<=>"), (2, "A::B::new"), (3, "new")]
    paths = {"algorithm/sort.html": "std::sort", "list/list/merge.html": "std::list::merge", "algorithm/ranges_sort.html": "std::ranges::sort", "vector/vector/op_equal.html": "std::vector::operator==", "vector/vector/op_constructor.html": "std::vector", "vector/vector/op_destructor.html": "std::vector::~vector", "chrono/duration/count.htm": "std::chrono::duration::count", "chrono.html": "x"}
    cpp = spark.createDataFrame([("c", "ja", f"https://c.example/reference/{p}", "x", "c", i) for i, p in enumerate(paths)], schema)
    assert rows(rec.explicit_titles(cpp, jobs, cpp_sources=["c"]).select("pos", "title"), "pos") == list(enumerate(paths.values()))
    jobs = spark.createDataFrame([("e", "en", "exdoc-sidebar"), ("j", "en", "javadoc-types")], "source_id string, docs_locale string, adapter string")
    cases = [("e", "t()", "Date", "Date.t()"), ("e", "Date.now()", "Date", "Date.now()"), ("e", "now(a, b)", "Date", "Date.now(a, b)"), ("e", "f(a)(b)", "Date", "f(a)(b)"), ("e", "intro", "Date", "intro"), ("e", "ok?(x)", None, "ok?(x)"), ("j", "List", "java.util", "java.util.List"), ("j", "", "java.util", "")]
    named = spark.createDataFrame([(s, "en", "https://d.example/x.html", t, sec, i) for i, (s, t, sec, _) in enumerate(cases)], schema)
    assert rows(rec.explicit_titles(named, jobs).select("pos", "title"), "pos") == [(i, c[3]) for i, c in enumerate(cases)]
    same = spark.createDataFrame([("s", "en", "https://a.example/a-b/x", "Intro", "Core", 1), ("s", "en", "https://a.example/1.2/x", " intro ", None, 2), ("s", "en", "https://a.example/q/x", "Only", None, 3)], schema)
    assert rows(rec.qualify_titles(same).select("pos", "title"), "pos") == [(1, "Intro — Core"), (2, " intro "), (3, "Only")]
    assert rows(rec.qualify_titles(same, exempt=["s"]).select("title").where("title like '%—%'")) == []


def test_nested_toc(spark):
    tree = [{"type": "groupMarker", "title": "G"}, {"title": "A", "path": "/a", "children": [{"title": "B", "path": "/b"}, {"type": "groupMarker", "title": "H"}, {"title": "C", "path": "/c"}]}, {"title": "D", "path": "/d"}, "junk"]
    df = docs(spark, json.dumps(tree), "not json", None, json.dumps({"items": [{"title": "P", "children": [{"title": "Q", "path": "/q"}]}]}))
    assert rows(x.flatten_toc(df.limit(3)).select("title", "path", "section"), "pos") == [("A", "/a", "G"), ("B", "/b", "G"), ("C", "/c", "H"), ("D", "/d", "G")]
    assert rows(x.flatten_toc(df, roots="items").where("doc_id = 3").select("title", "section")) == [("Q", "P")]
    assert rows(x.localized_share(spark.createDataFrame([(1, "日本"), (1, "en")], "doc_id long, title string"))) == [(1, 0.5)]
    deep = '[' + '{"title":"n","path":"/p","children":[' * 300 + ']}' * 300 + ']'
    assert x.flatten_toc(docs(spark, deep)).count() == 300


def test_outline_in_yaml(spark):
    body = """# Guide
items:
- name: Start
  href: index.md
- name: 'Language: all'
  items:
  - name: Types # kinds
    href: types/index.md
  - name: Flow
    items:
      - name: "If"
        href: if.md
  - href: nameless.md
- name: End
  href: end.md
"""
    got = rows(x.flatten_toc(docs(spark, body.replace("items:\n- name: Start", "- name: Start"), "", None), children="items", title="name", path="href", form="yaml").select("title", "path", "section"), "pos")
    assert got == [("Start", "index.md", None), ("Types", "types/index.md", "Language: all"), ("If", "if.md", "Flow"), ("End", "end.md", None)]
    paths = spark.createDataFrame([("/a/b",), ("/ja/a",), ("a",)], "p string").select(x.locale_prefixed(F.col("p"), "ja").alias("p"))
    assert rows(paths) == [("/ja/a/b",), ("/ja/a",), ("a",)]


def test_script_of_a_page(spark):
    df = docs(spark, '<script src="/x.js"></script><script src="dist/sidebar_items-1A.js">', "<script src='https://o.example/sidebar_items-2.js'>", "<p>none")
    assert rows(x.discover_script(df, r"^sidebar_items-.+\.js$"), "doc_id") == [(0, "https://x.example/d0/dist/sidebar_items-1A.js", True), (1, "https://o.example/sidebar_items-2.js", False), (2, None, False)]


def test_markdown(spark):
    body = "\n".join(["# Top #", "- [**A** b](a.md) text", "[Alone](b.md)", "say [In](c.html#x) and ![no](d.html) or [Two](e.html \"t\")", "## Sub", "  * [C](c.md)", "not [this](z.md)"])
    assert rows(x.markdown_links(docs(spark, body, None)).select("pos", "depth", "title", "href", "section"), "pos") == [(1, 0, "A b", "a.md", "Top"), (2, 0, "Alone", "b.md", "Top"), (5, 2, "C", "c.md", "Sub")]
    assert rows(x.markdown_inline_links(docs(spark, body), r"\.html").select("title", "href"), "pos") == [("In", "c.html#x"), ("Two", "e.html")]
    anchored = '# <a name="a"></a> One\n## <a id=b></a> Two\n# plain\n### <a name=c></a> Three ##'
    assert rows(x.markdown_anchored_headings(docs(spark, anchored)).select("level", "title", "anchor", "section"), "pos") == [(1, "One", "a", "One"), (2, "Two", "b", "One"), (3, "Three", "c", "One")]
    table = "| [X][D] | a | \n[d]: https://old\n### Stage 2.7\n| [Y](https://y) | b |\n|---|---|\n| [Z] \\| z | c |\n| none | d |\n[D]: https://new"
    got = rows(x.markdown_status_tables(docs(spark, table), "inactive").select("pos", "title", "link", "status"), "pos")
    assert got == [(0, "X", "https://new", "inactive: a"), (3, "Y", "https://y", "stage-2.7"), (5, "[Z] | z", "0#5", "stage-2.7")]


def test_url_resolve_agrees_with_the_helper(spark):
    from shelfspark.functions import urls as u

    bases = ["https://a.example/x/y?q#f", "http://A.example", "https://a.example:443/x", "nonsense", "https://a.example?x"]
    hrefs = ["/a", "/", "//o.example/b", "/a/../b", "/a/./b/", "/é,.", "b c", "/a?x=1#y", "/a?", "/a#", "https://o.example/p", "https://o.example", "HTTPS://O.example/p", "mailto:x", "?q", "#f", "", None, "/a//b", "\\\\x", "/a/..", "https://o.example/../p", "http://o.example:80/"]
    df = spark.createDataFrame([(a, b) for a in bases for b in hrefs], "b string, h string")
    for r in df.select("b", "h", u.url_resolve(F.col("b"), F.col("h")).alias("r")).collect():
        assert r.r == u.resolve(r.b, r.h), (r.b, r.h)


def test_links(spark):
    df = docs(spark, "<a href='a'>A</a><a href='a#x'>A2</a><a href='a'>again</a><a href='https://o.example/'>o</a><a href='../up?q'>up</a>")
    links = x.extract_html_links(df)
    assert rows(x.link_records(links, prefix="https://x.example/d0/").select("link", "text"), "pos") == [("https://x.example/d0/a", "A"), ("https://x.example/d0/a#x", "A2")]
    assert rows(x.scoped_links(links, "https://x.example/d0", prefer_last=True).select("link", "text")) == [("https://x.example/d0/a", "again")]
    assert rows(x.scoped_links(links, "https://x.example/d0", bare=False, exclude=["/d0/a"]).select("link")) == []
    assert rows(ref.canonical_links(x.link_records(links).select("doc_id", F.col("link").alias("url"))))[0][1].count("\n") == 3


def test_refresh(spark):
    gone = pytest.raises(ValueError)
    jobs = spark.createDataFrame([("a", "en", "weekly"), ("a", "ja", "monthly"), ("b", "en", "weekly")], "source_id string, docs_locale string, update_frequency string")
    assert rows(ref.select_jobs(jobs, ["a"], ["a/ja"]).select("docs_locale")) == [("en",)]
    with gone:
        ref.select_jobs(jobs, ["zz"])
    with pytest.raises(ValueError):
        ref.select_jobs(jobs, ["a"], ["a"])
    size = spark.createDataFrame([("x" * 1000,), (None,)], "b string").select(ref.gzip_size("b").alias("n")).collect()
    assert 15 < size[0].n < 60 and size[1].n is None
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "source_id string, n int, s string")
    new = spark.createDataFrame([("b", 2, None), ("c", 3, "y")], "source_id string, n int, s string")
    head = lambda *x: spark.createDataFrame([x], "schema_version int, generator_version int, catalog_sha256 string")
    assert rows(ref.header_diff(head(2, 1, "a"), head(2, 1, "a"))) == [] and rows(ref.header_diff(head(2, 1, "a"), head(3, 1, None)), "field") == [("catalog_sha256",), ("schema_version",)]
    build = spark.createDataFrame([("a", "en", "supported", "a.json", "h", 1, 1, "i")], "source_id string, docs_locale string, status string, path string, output_sha256 string, record_count long, raw_bytes long, input_sha256 string")
    chosen = build.select("source_id", "docs_locale")
    with pytest.raises(ValueError):
        ref.partial_refresh(chosen, build, build, build.select("path", F.lit("h").alias("sha256"), "record_count", "raw_bytes"), ("status",), (head(2, 1, "a"), head(2, 2, "a")))
    with pytest.raises(ValueError):
        ref.partial_refresh(chosen, build, build.withColumn("status", F.lit("planned")), build.select("path", F.lit("h").alias("sha256"), "record_count", "raw_bytes"), ("status",), (head(2, 1, "a"), head(2, 1, "a")))
    assert rows(ref.manifest_diff(old, new, ("source_id",)), "source_id") == [("a", "removed", []), ("b", "changed", ["s"]), ("c", "added", [])]


def test_stream(spark, tmp_path):
    raw = spark.createDataFrame([(1, "u1", "<title>A</title>", 0), (2, "u1", "<title>A</title>", 1), (3, "u2", "<title>B</title>", 2)], "doc_id long, url string, body string, s int").withColumn("fetched_at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).withColumn("source_id", F.lit("a")).drop("s")
    for i in (1, 2, 3):
        raw.where(f"doc_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    extract = lambda batch: batch.select("doc_id", "url", x.page_title(F.col("body")).alias("title"))
    query = streaming.keep_records(streaming.changed_documents(stream), extract, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]


def test_builds_are_published_whole(spark, tmp_path, monkeypatch):
    """Only new bundles are written; a build that fails leaves the one before; what two builds don't name goes."""
    folder = f"{tmp_path}/site"
    jobs = spark.createDataFrame([("a", "en", "https://x/"), ("b", "en", "https://x/"), ("c", "en", "https://x/")], "source_id string, docs_locale string, url_prefix string")

    def packed(**titles):
        rows = [("en", k, v, f"https://x/{k}", None, None, 0) for k, v in titles.items()]
        records = spark.createDataFrame(rows, "docs_locale string, source_id string, title string, url string, section string, proposal_status string, pos long")
        out = bun.pack_bundles(records, jobs)
        return out, out.select("source_id", "docs_locale", "path", "record_count", F.lit(1).alias("manifest_pos"))

    def titles():
        header, entries, bundles = pub.read_build(spark, folder, "source_id string, docs_locale string, path string, record_count bigint")
        return header.first().catalog_sha256, {x.source_id: x.title for x in bun.explode_records(bundles).collect()}

    assert pub.publish_build(*packed(a="One", b="Two"), folder, "h1") == {"written": 2, "kept": 0, "removed": 0}
    assert pub.publish_build(*packed(a="One", b="Deux"), folder, "h2") == {"written": 1, "kept": 1, "removed": 0}
    assert titles() == ("h2", {"a": "One", "b": "Deux"})

    def broken(*_, **__):
        raise OSError("no room")

    with monkeypatch.context() as m:
        m.setattr(bun, "publish_manifest", broken)
        with pytest.raises(OSError):
            pub.publish_build(*packed(a="Uno", b="Due"), folder, "h3")
    assert titles() == ("h2", {"a": "One", "b": "Deux"})
    lost, manifest = packed(a="Uno", b="Due")
    with pytest.raises(ValueError):
        pub.publish_build(lost.where("source_id = 'a'"), manifest.withColumn("path", F.concat("path", F.lit("x"))), folder, "h3")
    assert titles()[0] == "h2"
    assert pub.publish_build(*packed(c="Three"), folder, "h4")["removed"] == 3  # One of h1 and Deux stay: the build before; Two, Uno, Due go
    assert titles() == ("h4", {"c": "Three"})
    with pytest.raises(RuntimeError):
        versions.commit(spark, folder, {}, 1)


def test_script_in_page_order(spark):
    bodies = [
        (1, """<img src="sidebar_items-1.js"><script src='/a/sidebar_items-2.js'></script><script src="/sidebar_items-3.js"></script>"""),
        (2, """<SCRIPT data-x="a>b" defer SRC = "sidebar_items-4.js"></script><script src='sidebar_items-5.js'>"""),
        (3, """<scripted src="sidebar_items-6.js"><script>src="sidebar_items-7.js"</script>"""),
    ]
    df = spark.createDataFrame([(i, "https://x.example/", b) for i, b in bodies], "doc_id int, url string, body string")
    got = {r.doc_id: (r.link, r.sound) for r in x.discover_script(df, "^sidebar_items-").collect()}
    assert got == {1: ("https://x.example/a/sidebar_items-2.js", True), 2: ("https://x.example/sidebar_items-4.js", True), 3: (None, False)}


def test_unreadable_outlines(spark):
    df = spark.createDataFrame([(1, "u", '- name: "F #1 guide"\n  href: a\n- {name: B, href: b}\n- name: >-\n    C\n    d\n  href: c\n'), (2, "u", "- &x a\n"), (3, "u", None)], "doc_id int, url string, body string")
    got = x.flatten_toc(df, "items", "name", "href", form="yaml").orderBy("pos").collect()
    assert [(r.doc_id, r.title, r.path) for r in got] == [(1, "F #1 guide", "a"), (1, "B", "b"), (1, "C d", "c")]
    assert [(r.doc_id, r.reason) for r in x.unreadable_toc(df, "yaml").collect()] == [(2, "line 1: values that start with & are not read")]


def test_one_pass_equals_single_jobs(spark):
    body = """<h1 id=t>Top</h1><ul class=toc><li class=part>Part<li><a href=/m>1.2 M</a><ul><li><a href=/n>N</a></ul></ul>
    <emu-clause id=c1><h2 id=x>One</h2><table><tr><td><a href=/p>P</a><td>b<span>s</span></table></emu-clause><emu-annex id=c2><h3></h3></emu-annex><script><a href=/no>no</a></script>"""
    df = spark.createDataFrame([(1, "https://u/", body), (2, "https://v/", None)], "doc_id int, url string, body string")
    jobs = {
        "a": ("links", {}), "b": ("headings", {}), "c": ("clauses", {"tags": ("emu-clause", "emu-annex")}), "d": ("table_rows", {"min_cells": 2}),
        "e": ("subtree_links", {"marker": "/m"}), "f": ("toc_parts", {"list_class": "toc", "part_class": "part"}),
    }
    alone = {"a": x.extract_html_links(df), "b": x.extract_html_headings(df), "c": x.extract_clauses(df, ("emu-clause", "emu-annex")), "d": x.extract_table_rows(df, 2), "e": x.subtree_links(df, "/m"), "f": x.toc_parts(df, "toc", "part")}
    rows = x.extract_all(df, jobs)
    for name, (kind, _) in jobs.items():
        own = x.job_rows(rows, name, kind)
        assert own.columns == alone[name].columns and [*map(str, own.collect())] == [*map(str, alone[name].collect())] != [], kind


def test_bundles_in_parts(spark):
    """Parts of bounded rows, in order; one part is the bundle of old; each fault is found."""
    rows = [("en", src, f"T{i}", f"https://x/{i}", "S" if i % 2 else None, None, 7 * i % 100_003) for src, n in (("a", 95), ("b", 10), ("c", 1)) for i in range(n)]
    records = spark.createDataFrame(rows, "docs_locale string, source_id string, title string, url string, section string, proposal_status string, pos long").repartition(5)
    jobs = spark.createDataFrame([(x, "en", "https://x/") for x in "abc"], "source_id string, docs_locale string, url_prefix string")
    parts = bun.cut(bun.pack_parts(records, jobs, 10))
    got = {(r.source_id, r.part): r for r in parts.collect()}
    assert [got["a", i].record_count for i in range(10)] == [10] * 9 + [5] and got["a", 3]["first"] == 30 and got["a", 3].parts == 10
    whole = {r.source_id: r for r in bun.pack_bundles(records, jobs).collect()}
    for x in "bc":
        assert (got[x, 0].body, got[x, 0].path, got[x, 0].output_sha256) == (whole[x].body, whole[x].path, whole[x].output_sha256)
    read = parts.select("source_id", "docs_locale", "url_prefix", "first", F.from_json("body", bun.BUNDLE)["records"].alias("records"))
    back = bun.explode_records(read).where("source_id = 'a'").orderBy("pos").collect()
    assert [(r.pos, r.title) for r in back] == [(i, t) for i, (_, t) in enumerate(sorted((r[6], r[2]) for r in rows if r[1] == "a"))]
    manifest = parts.groupBy("source_id", "docs_locale").agg(F.sum("record_count").alias("record_count"), F.min("output_sha256").alias("output_sha256"))
    assert bun.validate_parts(parts, manifest).count() == 0
    faulty = {
        "hash": (parts.withColumn("body", F.when(F.col("part") == 2, F.replace("body", F.lit('"T'), F.lit('"U'))).otherwise(F.col("body"))), manifest),
        "order": (parts.where("part <> 2"), manifest), "count": (parts.where("part <> 9"), manifest), "unknown": (parts, manifest.where("source_id <> 'a'")),
        "missing": (parts.where("source_id <> 'a'"), manifest), "record": (parts.withColumn("body", F.when(F.col("part") == 1, F.lit("{}")).otherwise(F.col("body"))), manifest),
    }
    for reason, (some, of) in faulty.items():
        assert [(r.source_id, r.reason) for r in bun.validate_parts(some, of).collect()] == [("a", reason)], reason
