"""Steps whose work must grow no faster than their input."""

from shelfspark.operators import extract as x
from shelfspark.operators import records as rec


def test_lines_do_not_carry_all_marks(spark):
    """A document of many headings: what leaves the last explode for each line has no array of the document's headings."""
    body = "".join(f"# H {i}\n- [L {i}](l{i}.md)\n- [M](m.md)\n" for i in range(3000))
    df = x.markdown_links(spark.createDataFrame([(1, "- [A](a.md)\n" + body)], "doc_id long, body string"))
    generate = df._jdf.queryExecution().optimizedPlan()
    while generate.nodeName() != "Generate":
        generate = generate.children().head()
    kinds = [generate.output().apply(i).dataType().typeName() for i in range(generate.output().size())]
    assert "array" not in kinds
    rows = sorted((r.pos, r.title, r.section) for r in df.collect())
    want = [(0, "A", None)] + [row for i in range(3000) for row in ((3 * i + 2, f"L {i}", f"H {i}"), (3 * i + 3, "M", f"H {i}"))]
    assert rows == want


def test_explicit_titles_have_a_short_plan(spark):
    """No step of a name is worked out again for each time that it is used."""
    records = spark.createDataFrame(
        [("c", "en", "size", None, "https://c.example/reference/chrono/day/op_constructor.html", 1), ("d", "en", "f(x)", "M", None, 2), ("d", "en", None, None, "x", 3)],
        "source_id string, docs_locale string, title string, section string, url string, pos int",
    )
    jobs = spark.createDataFrame([("d", "en", "exdoc-sidebar")], "source_id string, docs_locale string, adapter string")
    named = rec.explicit_titles(records, jobs, ["c"], ["r"])
    assert named.columns == ["source_id", "docs_locale", "title", "section", "url", "pos"]
    assert len(named._jdf.queryExecution().executedPlan().toString()) < 50_000
    assert sorted((r.pos, r.title) for r in named.collect()) == [(1, "std::chrono::day"), (2, "M.f(x)"), (3, None)]


def test_postings_are_lists(spark, tmp_path):
    """An index keeps a row for a gram of a batch and scope, not one for each record, and gives back the rows of a scan."""
    from pyspark.sql import functions as F

    from shelfspark.operators import index
    from shelfspark.operators import search as s

    odd = ["", "a", "ab", "\u00e9\U0001d4b3\u6f22\u5b57", "x" * 50, "aa aa"]
    rows = [(odd[i] if i < len(odd) else f"common title {i % 7}", None, f"u{i}", f"s{i % 2}" if i % 5 else None, "en", i) for i in range(2000)]
    records = spark.createDataFrame(rows, "title string, section string, url string, source_id string, docs_locale string, pos int").coalesce(1)
    index.append(records, f"{tmp_path}/index")
    held, scanned = index.open_index(spark, f"{tmp_path}/index"), s.Scanned(s.prepared(records))
    urls = {x._row: x.url for x in held.rows.collect()}, {x._row: x.url for x in scanned.rows.collect()}
    values = [g for n in (1, 2, 3) for t in (*odd, "common title 3") for g in {t[i : i + n] for i in range(len(t) - n + 1)}]
    wanted = spark.createDataFrame([(v,) for v in set(values)], "gram string")
    found, want = (
        sorted(((x.gram, x.source_id or "", x.docs_locale, at[x._row]) for x in p.grams(wanted).collect()))
        for p, at in zip((held, scanned), urls)
    )
    assert found == want and len(want) > 20_000
    counts = [{x.gram: x.n for x in p.gram_counts(wanted).collect()} for p in (held, scanned)]
    assert counts[0] == counts[1]
    words = spark.createDataFrame([("common",), ("aa",), ("title",)], "word string")
    assert [sorted((x.word, at[x._row]) for x in p.words(words).collect()) for p, at in zip((held, scanned), urls)][0] == sorted(
        [(w, f"u{i}") for i in range(len(odd), 2000) for w in ("common", "title")] + [("aa", "u5")]
    )
    for name in ("grams", "words"):
        kept = held._of(name).agg(F.count("*").alias("rows")).first().rows
        assert kept < 2000, f"{name}: {kept} rows"
