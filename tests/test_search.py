"""Search against a plain-Python model, and its parts."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import index
from shelfspark.operators import results as r
from shelfspark.operators import search as s

SCHEMA = "title string, url string, section string, programming_language string, docs_locale string, source_id string, source_name string, source_kind string, document_kind string, proposal_status string, catalog_pos int, pos long"
WORDS = ["sort", "search", "stable_sort", "iterator", "vector", "hash", "map", "Überladen", "merge", "sorted", "partition", "for_each"]


def library(seed, n=80):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["cpp", "go", "rust"])
        out.append((" ".join(rng.sample(WORDS, rng.randint(1, 3))), f"https://x.example/{rng.randint(0, n)}", rng.choice([None, "Core", "Sort"]), lang, "en", f"{lang}-{rng.randint(0, 1)}", f"N {lang}", rng.choice(["official", "community"]), rng.choice(["reference", "proposal"]), rng.choice([None, "withdrawn", "stage-0"]), i % 2, i))
    return out


def normal(x):
    return " ".join((x or "").lower().replace("_", " ").replace("-", " ").split())


def osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def distance(token, hay):
    if token in hay:
        return 0
    most = 2 if len(token) >= 8 else 1
    if len(token) < 4 or not token.isalnum():
        return None
    near = [osa(token, w) for w in hay.split() if len(w) >= 4 and w.isalnum() and abs(len(w) - len(token)) <= most and (len(token) >= 7 or len(w) == len(token))]
    return min((x for x in near if x <= most), default=None)


def points(rec, q, tokens, fuzzy):
    title, section = normal(rec[0]), normal(rec[2])
    hay = f"{title} {section}".strip()
    distances = [distance(t, hay) if fuzzy else 0 if t in hay else None for t in tokens]
    if None in distances:
        return 0
    total = 40 + (100 if title == q else 75 if title.startswith(q) else 55 if q in title else 0)
    total += sum(30 if title == t else 20 if title.startswith(t) else 12 if t in title else 4 if t in section else 0 for t in tokens)
    total += -18 * sum(distances) + 5 * (rec[7] == "official") - 12 * (rec[8] == "proposal") - {"withdrawn": 8, "stage-0": 4}.get(rec[9], 0)
    return total - min(len(title) / 100, 5)


def diverse(rows, limit):
    by_lang = {}
    for x in rows:
        by_lang.setdefault(x["lang"], []).append(x)
    out = []
    for k in range(3):
        if len(out) >= limit:
            break
        out += [bucket[k] for bucket in by_lang.values() if len(bucket) > k]
    for x in rows:
        if len(out) >= limit:
            break
        if x not in out:
            out.append(x)
    return out


def model(records, query, limit):
    q = normal(query)
    tokens = list(dict.fromkeys(q.split()))
    if not tokens:
        return [], []
    seen, facets, phases = set(), set(), []
    for fuzzy in (False, True):
        kept = {}
        for rec in sorted(records, key=lambda x: (x[10], x[11])):
            if (p := points(rec, q, tokens, fuzzy)) <= 0:
                continue
            facets.add(rec[5])
            if rec[1] not in seen:
                seen.add(rec[1])
                kept.setdefault(rec[3], []).append({"score": p, "title": rec[0], "url": rec[1], "lang": rec[3], "scan": (rec[10], rec[11])})
        order = lambda x: (-round(x["score"], 9), x["title"], x["url"], x["scan"])
        kept = [x for bucket in kept.values() for x in sorted(bucket, key=order)[:limit]]
        phases.append(sorted(kept, key=order))
        if not fuzzy and len(kept) >= min(limit, 12):
            break
    out = diverse(phases[0], limit)
    if len(phases) > 1:
        out += diverse(phases[1], limit - len(out))
    return [x["url"] for x in out], sorted(facets)


@pytest.mark.parametrize("plan", ["broadcast", "trigrams"])
def test_search(spark, plan):
    records = library(1)
    queries = ["sort", "srot", "stable sort", "Iteratr", "vetcor", "überladen hash", "partitoin merge", "x", "", "map", "core", "for each", "sorted sort", "hsah"]
    asked = [(i, q, 1 + i % 7) for i, q in enumerate(queries)]
    found, facets = s.search(spark.createDataFrame(asked, "query_id int, query string, limit int"), spark.createDataFrame(records, SCHEMA).repartition(3), plan=plan)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.query_id, x.place)):
        got.setdefault(x.query_id, []).append(x.url)
    sides = {}
    for x in sorted(facets.collect(), key=lambda x: x.source_id):
        sides.setdefault(x.query_id, []).append(x.source_id)
    for i, q, limit in asked:
        urls, sources = model(records, q, limit)
        assert got.get(i, []) == urls, q
        assert sides.get(i, []) == sources, q


def test_distance(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    pairs = [(word(), word()) for _ in range(400)]
    for _ in range(2500):
        a = b = word()
        for _ in range(rng.randint(0, 3)):
            k, kind = rng.randint(0, len(b)), rng.randint(0, 3)
            b = [b[:k] + rng.choice("abcd") + b[k:], b[:k] + b[k + 1 :], b[:k] + rng.choice("abcd") + b[k + 1 :], b[:k] + b[k + 1 : k + 2] + b[k : k + 1] + b[k + 2 :]][kind]
        pairs.append((a, b))
    pairs += [("ca", "abc"), ("abc", "ca"), ("abcd", "badc"), ("ab", "ba"), ("a", ""), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", *(s.osa_distance(F.col("a"), F.col("b"), most).alias(f"d{most}") for most in (1, 2))).collect()
    for x in got:
        want = osa(x.a, x.b)
        assert (x.d1, x.d2) == (want if want <= 1 else None, want if want <= 2 else None), (x.a, x.b)


def test_close_words_are_complete(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 11))) for _ in range(250)]
    tokens = [w[: k] + w[k + 1] + w[k] + w[k + 2 :] if rng.random() < 0.4 and len(w) > 4 else w[:k] + w[k + 1 :] for w in words[:120] for k in [rng.randrange(len(w) - 1)]]
    got = {(x.token, x.word): x.distance for x in s.close_words(spark.createDataFrame([(x,) for x in tokens], "token string"), spark.createDataFrame([(x,) for x in words], "word string")).collect()}
    want = {}
    for a in set(tokens):
        for b in set(words):
            most = 2 if len(a) >= 8 else 1
            if len(a) >= 4 and len(b) >= 4 and abs(len(a) - len(b)) <= most and (len(a) >= 7 or len(a) == len(b)) and osa(a, b) <= most:
                want[a, b] = osa(a, b)
    assert got == want and len(want) > 50


def test_diversify(spark):
    rng = random.Random(4)
    rows = [(qid, f"t{i}", f"u{i}", rng.choice("abc"[: 1 + qid % 3]), float(rng.randint(0, 30)), limit, 0, i) for qid in range(30) for limit in [rng.randint(-1, 12)] for i in range(rng.randint(0, 25))]
    df = spark.createDataFrame(rows, "query_id int, title string, url string, programming_language string, score double, limit int, catalog_pos int, pos long")
    got = {}
    for x in s.diversify(df).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append(x.url)
    for qid in range(30):
        own = sorted((x for x in rows if x[0] == qid), key=lambda x: (-x[4], x[1], x[2]))
        assert got.get(qid, []) == [x["url"] for x in diverse([{"url": x[2], "lang": x[3]} for x in own], own[0][5])] if own else True


def test_grouping(spark):
    titles = [("std::sort", "a"), ("std :: sort()", "b"), ("std::sort", "a"), ("std::Sort", "c"), ("plain title", "a"), ("plain title", "b"), ("a.b()", "a"), ("a.b", "b"), ("std::sort", "d")]
    rows = [(1, i + 1, t, src, "en", "cpp", "proposal" if i == 8 else "reference", None) for i, (t, src) in enumerate(titles)]
    df = spark.createDataFrame(rows, "query_id int, place int, title string, source_id string, docs_locale string, programming_language string, document_kind string, qualification string")
    got = {x.place: (x.group_rank, x.member_rank) for x in r.group_results(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (7, 2), 9: (9, 1)}


def test_symbol_keys(spark):
    cases = {"std :: sort ( )": "std::sort", " a.b": "a.b", "a . b()": "a.b", "A#b": "A#b", "go to  x()": "go to x", "x)": None, "plain title": None, "3. item": None, "f(x)": None, "()": None, "ns::f(x)": "ns::f(x)", "é.ü": "é.ü", None: None}
    got = spark.createDataFrame([(x,) for x in cases], "t string").select("t", r.symbol_key(F.col("t")).alias("k")).collect()
    assert {x.t: x.k for x in got} == cases


@pytest.mark.parametrize("match", [s.match_exact, s.match_fuzzy])
def test_blocked_plan_compares_no_all_pairs(spark, match):
    q = s.tokenized(spark.createDataFrame([(1, "sorted map", 3), (2, "x", 3)], "query_id int, query string, limit int"))
    pairs = match(q, s.prepared(spark.createDataFrame(library(2), SCHEMA)), "trigrams").where(F.length("q") > 0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_short_queries_and_repeated_rows_by_trigrams(spark):
    records = library(5) + library(5)
    q = s.tokenized(spark.createDataFrame([(1, "o", 3), (2, "ma", 3), (3, "o rt", 3), (4, "sort o", 3)], "query_id int, query string, limit int"))
    rows = s.prepared(spark.createDataFrame(records, SCHEMA).repartition(3))
    got = [sorted((x.query_id, x.title, x.pos) for x in s.match_exact(q, rows, plan).collect()) for plan in ("broadcast", "trigrams")]
    assert got[0] == got[1] and len(got[0]) > 100


def test_names_order_by_value(spark):
    names = ["C10", "C2", "c02", "C", "C2x", "B9", "B10", "É1", "10", "9", "C2.10", "C2.9", ""]
    rows = [(1, i, f"t{i}", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "query_id int, group_rank int, title string, programming_language string")
    got = [x.programming_language for x in r.order_groups(df, "language-asc").orderBy("group_place").collect()]
    assert got == ["", "9", "10", "B9", "B10", "C", "C2", "c02", "C2.9", "C2.10", "C2x", "C10", "É1"]
    back = [x.programming_language for x in r.order_groups(df, "language-desc").orderBy("group_place").collect()]
    assert [x for x in back if x not in ("C2", "c02")] == [x for x in got[::-1] if x not in ("C2", "c02")] and back.index("C2") < back.index("c02")


def test_index_equals_scan(spark, tmp_path):
    """Segments that were added and merged find what a scan does; an index without commit is not seen."""
    records, folder = library(6, 120), f"{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = ["sort", "srot", "stable sort", "vetcor map", "überladen hash", "partitoin merge", "x", "o", "or it", "for each"]
    asked = spark.createDataFrame([(i, q, 3 + i % 4) for i, q in enumerate(queries)], "query_id int, query string, limit int")
    rows = lambda found: sorted((x.query_id, x.place, x.url, round(x.score, 6)) for x in found.collect())
    index.append(frame(records[:50]), folder)
    index.append(frame(records[50:]), folder)
    want = [rows(s.search(asked, frame(records), plan=plan)[0]) for plan in ("trigrams", "broadcast")]
    assert want[0] == want[1] and rows(s.search(asked, index.open_index(spark, folder))[0]) == want[0]
    held = index.open_index(spark, folder)
    assert index.merge(spark, folder) == 3
    assert rows(s.search(asked, held)[0]) == want[0] and rows(s.search(asked, index.open_index(spark, folder))[0]) == want[0]
    assert len(index.open_index(spark, folder).segments) == 1
    scope = spark.createDataFrame([(i, src) for i in range(len(queries)) for src in (["cpp-0"], ["go-1", "rust-0"])[i % 2]], "query_id int, source_id string")
    scoped = [rows(s.search(asked, x, scope=scope)[0]) for x in (frame(records), index.open_index(spark, folder))]
    assert scoped[0] == scoped[1] and scoped[0]


def test_index_reads_asked_postings(spark, tmp_path):
    """The plan reads the buckets of the asked grams and works no grams out."""
    index.append(spark.createDataFrame(library(7), SCHEMA), f"{tmp_path}/index")
    held = index.open_index(spark, f"{tmp_path}/index")
    q = s.tokenized(spark.createDataFrame([(1, "merge", 3)], "query_id int, query string, limit int"))
    plan = s.match_exact(q, None, postings=held)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "gram#" in line and "bucket#" in line)
    assert "(bucket#" in scan.split("PartitionFilters:")[1] and "EqualTo(gram," in scan.split("PushedFilters:")[1]
    assert "Generate explode" not in plan and "NestedLoopJoin" not in plan


def test_scope_reads_its_partition(spark, tmp_path):
    spark.createDataFrame(library(8), SCHEMA).write.partitionBy("source_id", "docs_locale").parquet(f"{tmp_path}/records")
    scope = spark.createDataFrame([(1, "go-1")], "query_id int, source_id string")
    seen = s.in_scope(spark.read.parquet(f"{tmp_path}/records"), scope)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "go-1" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {x.source_id for x in seen.collect()} == {"go-1"} and all("source_id=go-1" in f for f in seen.inputFiles() if "source_id=go-1" in f)


def test_candidates_come_from_the_rarest_part(spark):
    """Every record has the common words; candidates are as many as the rare word's records."""
    records = [(f"common words here {'quixotic' if i % 100 == 0 else f'filler{i}'}", f"https://x.example/{i}", None, "go", "en", "go-0", "N", "official", "reference", None, 0, i) for i in range(1000)]
    rows = s.prepared(spark.createDataFrame(records, SCHEMA))
    q = s.tokenized(spark.createDataFrame([(1, "cmomon words quixotik", 3), (2, "common wrods", 3)], "query_id int, query string, limit int"))
    close = s.cut(s.close_words(q.select(F.explode("tokens").alias("token")), s.Scanned(rows).vocabulary()))
    for plan in ("broadcast", "trigrams"):
        made = {x.query_id: x["count"] for x in s.fuzzy_candidates(q, rows, close, plan).groupBy("query_id").count().collect()}
        found = {x.query_id: x["count"] for x in s.match_fuzzy(q, rows, plan).groupBy("query_id").count().collect()}
        assert made == {1: 10, 2: 1000} and found == {1: 10, 2: 1000}


def test_searches_leave_only_results(spark):
    """The shared folder is as before, but for the results; also after a failure."""
    from shelfspark.shared import settled_all, shared_folder
    from shelfspark.sources.versions import listed

    before = set(listed(spark, shared_folder(spark)))
    asked = spark.createDataFrame([(1, "srot map", 3)], "query_id int, query string, limit int")
    s.search(asked, spark.createDataFrame(library(9), SCHEMA))
    after = set(listed(spark, shared_folder(spark)))
    assert before <= after and len(after - before) == 2
    with pytest.raises(ZeroDivisionError):
        settled_all(spark, lambda: (s.cut(asked), 1 / 0))
    assert set(listed(spark, shared_folder(spark))) == after


def test_few_queries_make_no_grams_of_many_records(spark):
    """However many the records are, a few queries are looked for in them without postings; the rows are those of the trigrams."""
    texts = ["straße im wald", "wald", "im wald straße wald", "", None, "wa", "ld wald", "日本語の文書", "語の", "a b c"]
    records = spark.createDataFrame([(i, texts[i % 10]) for i in range(60_000)], "pos long, t string").selectExpr("pos", "t", "t as hay", "pos as _row")
    asked = [(1, ["wald"]), (2, ["wald", "straße"]), (3, ["語の"]), (4, ["b c"]), (5, ["ldwald"]), (6, ["a"]), (None, ["wald", "im"])]
    asked += [(i, [f"x{i}"]) for i in range(7, 400)]
    needles = spark.createDataFrame(asked, "query_id long, tokens array<string>")
    found = s.contained(needles, records, "query_id", "tokens")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "hashpartitioning" not in plan
    want = sorted((q or 0, i) for i in range(60_000) for q, parts in asked if texts[i % 10] is not None and all(p in texts[i % 10] for p in parts))
    assert sorted((r.query_id or 0, r.pos) for r in found.select("query_id", "pos").collect()) == want
    assert s.contained(needles.where("false"), records, "query_id", "tokens").count() == 0


def test_few_queries_with_typos_make_no_grams_of_many_records(spark, monkeypatch):
    def grams(*_):
        raise AssertionError("grams")

    monkeypatch.setattr(s.Scanned, "grams", grams)
    text = F.concat(F.lit("ordered mapping "), (F.col("id") % 300).cast("string"))
    rows = s.cut(spark.range(60_000).select(F.col("id").alias("_row"), text.alias("t"), F.lit("").alias("s"), text.alias("hay")))
    asked = [(i, ["orderde", str(i)]) for i in range(100, 300)]
    found = s.match_fuzzy(spark.createDataFrame(asked, "query_id long, tokens array<string>"), rows)
    got = found.select("query_id", "_row", F.col("distances")["orderde"].alias("d")).collect()
    assert sorted((r.query_id, r._row, r.d) for r in got) == sorted((i % 300, i, 1) for i in range(60_000) if i % 300 >= 100)


def test_few_queries_with_typos_need_no_postings(spark, monkeypatch):
    """One pass over the texts finds all tokens and the words close to them; no words of records, no deletions of words are made."""
    def made(*_):
        raise AssertionError("made")

    monkeypatch.setattr(s.Scanned, "words", made)
    monkeypatch.setattr(s, "_deletions", made)
    records = library(10, 60)
    rows = s.cut(s.prepared_columns(spark.createDataFrame(records, SCHEMA)))
    asked = [(1, ["srot"]), (2, ["vetcor", "map"]), (3, ["partitoin"]), (4, ["hsah", "sort"]), (5, ["sort"])]
    got = s.match_fuzzy(spark.createDataFrame(asked, "query_id long, tokens array<string>"), rows).select("query_id", "pos", "distances").collect()
    want = []
    for q, tokens in asked:
        for rec in records:
            found = {t: distance(t, f"{normal(rec[0])} {normal(rec[2])}".strip()) for t in tokens}
            if None not in found.values():
                want.append((q, rec[11], found))
    by = lambda x: x[:2]
    assert sorted(((x.query_id, x.pos, x.distances) for x in got), key=by) == sorted(want, key=by) and len(want) > 20


def test_parts_equal_brute_force():
    import pyarrow as pa

    from shelfspark.functions import parts

    rng = random.Random(12)
    some = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    for _ in range(60):
        texts, wanted = [some("abß ", 14) for _ in range(20)], list({some("abß ", 4) for _ in range(8)})
        found = parts.distances(pa.array(texts, pa.string()), wanted) == 0
        assert found.tolist() == [[p in t for t in texts] for p in wanted]
        words, token = [some("abcß", 9) for _ in range(20)], some("abcß", 9)
        for most in (1, 2):
            assert parts.Words(pa.array(words, pa.string())).near(token, most).tolist() == [i for i, x in enumerate(words) if osa(token, x) <= most]


def test_matches_are_kept_once_for_a_url_and_source(spark, monkeypatch):
    """Of many matches of a query at one URL, a search writes the first."""
    sizes, write = {}, s.cut
    monkeypatch.setattr(s, "cut", lambda df, *a: sizes.setdefault(tuple(df.columns), write(df, *a)))
    records = [(f"map {i}", f"https://x.example/{i % 3}", None, "go", "en", "go-0", "N", "official", "reference", None, 0, i) for i in range(300)]
    s._search(spark.createDataFrame([(1, "map", 3)], "query_id int, query string, limit int"), spark.createDataFrame(records, SCHEMA), 60, None, False, "broadcast", (), None)
    matches = next(df for columns, df in sizes.items() if "score" in columns and "lang_rank" not in columns)
    assert sorted(x.pos for x in matches.collect()) == [0, 1, 2]
