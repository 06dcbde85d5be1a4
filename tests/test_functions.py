"""Text, URL and HTML functions, and the query parser against a plain-Python model."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import html as h
from shelfspark.functions import query_text as q
from shelfspark.functions import text as t
from shelfspark.functions import urls as u


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "want"),
    [("  Foo__Bar--baz  Q ", "foo bar baz q"), ("Ｆｕｌｌ　ｗｉｄｔｈ ①", "full width 1"), ("ﬁne", "fine"), ("", ""), (None, None), ("ÉCOLE", "école")],
)
def test_normalize(spark, value, want):
    assert one(spark, value, t.normalize_text) == want


def test_words(spark):
    assert one(spark, "a-b a::c é1, a", t.words_of) == ["a", "b", "c", "é1"]
    assert one(spark, " a  b a ", t.tokens_of) == ["a", "b"]


@pytest.mark.parametrize(("value", "want"), [("&lt;a&gt; &amp;lt; &#x41;&#66; <![CDATA[x&y]]> &#xD800;", "<a> &lt; AB x&y &#xD800;"), ("&#99999999;", "&#99999999;")])
def test_entities(spark, value, want):
    assert one(spark, value, lambda c: t.decode_entities(c, numeric=True, cdata=True)) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("![i](x) **Bold** [link](u) `code` \\*star\\*", "Bold link code *star*"), ("a *b* <br/>c</b> [ref][x]", "a b c ref"), ("2 * 3 * 4", "2 * 3 * 4"), ("__x__ y", "x y")],
)
def test_markdown(spark, value, want):
    assert one(spark, value, t.plain_markdown) == want


def test_cells(spark):
    assert one(spark, r"a\|b<br>c", t.markdown_cell_text) == "a|b c"


@pytest.mark.parametrize(("value", "want"), [("Withdrawn", "not-current"), ("stage-1", "draft"), ("stage-10", "current"), ("", None), ("final", "current")])
def test_status(spark, value, want):
    assert one(spark, value, t.proposal_status_class) == want


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.example/x/y.html", "../z", "https://a.example/z"), ("https://a.example/x/", "\\b\\c", "https://a.example/b/c"), ("https://A.example:443", "", "https://a.example/"),
        ("https://a.example/x", "mailto:q", None), ("https://a.example/x?q#f", "#g h", "https://a.example/x?q#g%20h"), ("https://a.example/x/", "//B.example/./p/../q", "https://b.example/q"), ("https://a.example", None, None), ("https://a.example/a", "http://[bad", None),
    ],
)
def test_resolve(base, href, want):
    assert u.resolve(base, href) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("https://a.example/guide/json-api_v2.html", "Json Api V2"), ("https://a.example/getting-started/index.html?x", "Getting Started"), ("https://a.example/iOS%20app/", "IOS App"), ("https://a.example/a+b%zz", "A+B%Zz"), ("https://a.example/", ""), ("https://a.example/otp-fsharp.HTML", "OTP F#"), ("https://a.example/index.html", "")],
)
def test_title_from_url(spark, value, want):
    assert one(spark, value, u.title_from_url) == want


@pytest.mark.parametrize(("value", "want"), [("https://a.example/x/my-page_1.xml", "my page 1"), ("https://a.example/", "a.example"), ("https://a.example/index.html", "index"), ("https://a.example/q/index.htm", "q"), ("https://a.example/-", "Documentation")])
def test_slug_from_url(spark, value, want):
    assert one(spark, value, u.slug_from_url) == want


def test_doc_urls(spark):
    rows = spark.createDataFrame([("a/b.md", "x y"), ("a/index", None), ("../a", None), ("/a", None), ("index", "q"), ("c.html", "")], "p string, f string")
    got = [r[0] for r in rows.select(u.build_doc_url("https://d.example/", F.col("p"), F.col("f"))).collect()]
    assert got == ["https://d.example/a/b.html#x%20y", "https://d.example/a/", None, None, "https://d.example/#q", "https://d.example/c.html"]


def test_html():
    body = "<ul><li><a href=/a>A<b>b</b></a><li><a href='/c?x&amp;y'> C &amp;\n d </a><li><a href=/e></a></ul><script>'<a href=q>q</a>'</script><table><tr><td>1<td><a href=z>2</a><tr><td>3</table>"
    assert h.one(body, "links") == [{"pos": 0, "href": "/a", "text": "Ab"}, {"pos": 1, "href": "/c?x&y", "text": "C & d"}, {"pos": 2, "href": "z", "text": "2"}]
    assert [[c["text"] for c in r["cells"]] for r in h.one(body, "table_rows", min_cells=1)] == [["1", "2"], ["3"]] and h.one(body, "table_rows", min_cells=2)[0]["cells"][1]["href"] == "z"
    assert h.plain("a --- <b>b</b><style>p{}</style>&copy;") == "a — b©" and h.one(None, "links") == [] and h.plain(None) is None
    assert h.one("<h1 id=a>A<br>b</h1><h2>no</h2><h3 id=c>C</h3>", "headings") == [{"pos": 0, "level": 1, "id": "a", "text": "A b", "section": "A b"}, {"pos": 2, "level": 3, "id": "c", "text": "C", "section": "A b"}]
    assert [x["id"] for x in h.one("<emu-clause id=x><h1>X</h1><emu-clause id=y><p><h1>no</h1></p><emu-annex id=z><h2>Z</h2></emu-annex></emu-clause></emu-clause>", "clauses", tags=("emu-clause", "emu-annex"))] == ["x", "z"]


# Query strings ---------------------------------------------------------------------------------------------------

KNOWN = ["cpp", "go", "rust", "javascript", "python"]
LOGS = [
    "", "   ", "c,go,rust list", "rust, js, go iterator", "go", "go, ", "quick lang:python sort", "lang:py,js iterator", "iterator locale:fr", "dict key:value", "locale:ja source:all x LOCALE:en", "x source:Official lang:go lang:c++,py",
    "lang: x", "Lang:go a Source:x b", "c++  templates", "rust lang:go map lang:cpp", "golang,\tjs   closures", "source:all", "a lang:b locale:c d", "go:lang", ", x", "RUST Traits source:",
]


def model(raw):
    """The parser, token by token."""
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", raw)]
    name = lambda v: t.LANGUAGE_IDS.get(v.strip().lower(), v.strip().lower())
    prefixes = {"lang:": "language", "locale:": "locale", "source:": "source"}
    kind = lambda v: next((k for p, k in prefixes.items() if v.startswith(p)), None)
    langs, locale, mode, flags, errors = [], None, None, [], []
    if not tokens:
        return "", [], None, None, [], []
    n, joined = 1, tokens[0][0]
    while joined.endswith(",") and n < len(tokens):
        joined, n = joined + tokens[n][0], n + 1
    names = [name(x) for x in joined.split(",")]
    start, end = 0, len(tokens)
    if ":" not in joined and all(x in KNOWN for x in names):
        langs, start = names, n
        flags.append((0 + tokens[0][1], tokens[n - 1][2], "language", True))

    def apply(token):
        nonlocal langs, locale, mode
        k, value = kind(token[0].lower()), token[0].split(":", 1)[1].lower()
        bad = {"locale": value not in q.LOCALES, "source": value not in q.SOURCE_MODES}.get(k, False)
        flags.append((token[1], token[2], k, not bad))
        if bad:
            errors.append("invalid_locale" if k == "locale" else "invalid_source_mode")
        elif k == "language":
            langs = [x for x in map(name, value.split(",")) if x]
        elif k == "locale":
            locale = value
        else:
            mode = value

    while start < end and kind(tokens[start][0].lower()):
        apply(tokens[start])
        start += 1
    while end > start and kind(tokens[end - 1][0].lower()):
        end -= 1
        apply(tokens[end])
    for token in tokens[start:end]:
        if kind(token[0].lower()):
            flags.append((token[1], token[2], kind(token[0]) or "source", False))
            errors.append("flag_in_search_text")
    if start == end:
        errors.append("empty_search_text")
    return " ".join(x[0] for x in tokens[start:end]), list(dict.fromkeys(langs)), locale, mode, sorted(flags), errors


def test_parse_query(spark):
    df = spark.createDataFrame([(i, raw, KNOWN) for i, raw in enumerate([*LOGS, None])], "i int, raw string, known_languages array<string>")
    for r in q.parse_query(df).collect():
        got = (r.search_text, r.languages, r.locale, r.source_mode, [(f.start, f.end, f.kind, f.valid) for f in r.flags], [e.code for e in r.errors])
        assert got == model(r.raw or ""), r.raw


def test_texts_that_stay(spark):
    """Over all characters: what the pattern lets pass is normal, alone and beside others, and most letters pass."""
    import unicodedata

    chars = [chr(i) for i in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    rows = spark.createDataFrame(pd.DataFrame({"c": chars}))
    passed = {r.c for r in rows.where(~F.rlike("c", F.lit(t.nfkc_changes()))).toLocalIterator()}
    rng = random.Random(1)
    some = rng.sample(sorted(passed), 200) + list("eßé가각ㄱ")
    assert all(unicodedata.normalize("NFKC", c) == c for c in passed)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in some if a in passed for b in (*some, "é", "a", "ー") if b in passed)
    assert set("éßüñöабв漢字ひらがな") <= passed and not set("ﬁＡ²́ﾞ") & passed and "\u0301" not in passed
    texts = ["Straße_É", "ｆｕｌｌ", "e\u0301", "plain", None, "", "①-ﬁ"]
    got = {r.x: r.n for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.normalize_text(F.col("x")).alias("n")).collect()}
    assert got == {"Straße_É": "straße é", "ｆｕｌｌ": "full", "e\u0301": "é", "plain": "plain", None: None, "": "", "①-ﬁ": "1 fi"}
