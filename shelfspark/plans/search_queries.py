"""Queries of the search operators, each with its SQL where SQL can say it. Orders are by code point here, as in the SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.query_text import parse_query
from ..operators import index
from ..operators import results as r
from ..operators import search as s
from ..operators.runtime import run_requests as run_request_tables
from ..shared import shared_folder
from ..sources.versions import delete
from . import base as b

_R = ("query_id", "title", "url", "source_id", "programming_language", "place")


def _search(records, plan):
    def run(spark, d):
        found, _ = s.search(b.requests(spark, d), records(spark, d), plan=plan)
        return found.select(*_R, F.round("score", 4).alias("score"))

    return run


def search_index(spark, d):
    """Over an index that is built for it; the same rows as search_pages."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.append(b.page_records(spark, d), folder)
    found, _ = s.search(b.requests(spark, d), index.open_index(spark, folder))
    delete(spark, folder)
    return found.select(*_R, F.round("score", 4).alias("score"))


def search_appended(spark, d):
    """Over an index of two segments, one for each half of the records, and again after they are merged: what both find."""
    folder, records = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", b.page_records(spark, d)
    for half in (0, 1):
        index.append(records.where(F.col("pos") % 2 == half), folder)
    before, _ = s.search(b.requests(spark, d), index.open_index(spark, folder))
    index.merge(spark, folder)
    after, _ = s.search(b.requests(spark, d), index.open_index(spark, folder))
    delete(spark, folder)
    both = before.withColumn("state", F.lit("segments")).unionByName(after.withColumn("state", F.lit("merged")))
    return both.select("state", *_R, F.round("score", 4).alias("score"))


_POINTS = """40.0::DOUBLE + CASE WHEN t = q THEN 100 WHEN starts_with(t, q) THEN 75 WHEN contains(t, q) THEN 55 ELSE 0 END
  + list_sum(list_transform(toks, lambda x: CASE WHEN t = x THEN 30 WHEN starts_with(t, x) THEN 20 WHEN contains(t, x) THEN 12 WHEN contains(s, x) THEN 4 ELSE 0 END)) - 18 * edits
  + CASE WHEN source_kind = 'official' THEN 5 ELSE 0 END - CASE WHEN document_kind = 'proposal' THEN 12 ELSE 0 END
  - CASE WHEN regexp_matches(coalesce(proposal_status, ''), '(?i)withdrawn|rejected|superseded|inactive|deferred') THEN 8 WHEN regexp_matches(coalesce(proposal_status, ''), '(?i)draft|candidate|submitted|stage-[01](\\D|$)') THEN 4 ELSE 0 END
  - least(length(t) / 100.0::DOUBLE, 5)"""

#: After the exact phase's tables: rows that match with typos, for queries with few exact ones, placed after those.
_FUZZY = rf"""
out1 AS (SELECT * FROM results), gated AS (SELECT q.* FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM kept GROUP BY 1) USING (query_id) WHERE coalesce(n,
  0) < least("limit", 12)),
tokens AS (SELECT DISTINCT unnest(toks) AS token FROM gated), wordlist AS (SELECT pos, unnest(list_distinct(list_filter(string_split_regex(hay, '[^\p{{L}}\p{{N}}]+'),
  lambda x: x <> ''))) AS word FROM hay), words AS (SELECT DISTINCT word FROM wordlist), {b.CLOSE},
met AS (SELECT pos, token, min(distance) AS d FROM (SELECT pos, token, distance FROM close JOIN wordlist USING (word) UNION ALL SELECT pos, token, 0 FROM hay JOIN tokens
  ON contains(hay, token)) GROUP BY ALL),
edited AS (SELECT query_id, pos, sum(d) AS edits FROM (SELECT query_id, len(toks) AS n, unnest(toks) AS token FROM gated) JOIN met USING (token) GROUP BY query_id, pos,
  n HAVING count(*) = n),
near AS (SELECT * FROM (SELECT *, {_POINTS} AS score FROM edited JOIN hay USING (pos) JOIN gated USING (query_id)) WHERE score > 0),
fresh AS (SELECT * FROM near ANTI JOIN scored USING (query_id, url) QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY catalog_pos, pos) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, programming_language ORDER BY score DESC, title, url, catalog_pos, pos) AS lang_rank FROM fresh QUALIFY
  lang_rank <= "limit"),
rest AS (SELECT best.* EXCLUDE ("limit"), "limit" - coalesce(taken, 0) AS "limit", coalesce(taken, 0) AS taken FROM best LEFT JOIN (SELECT query_id, max(place) AS taken
  FROM out1 GROUP BY 1) USING (query_id))"""


def _again(names: str) -> str:
    """The steps that mix languages, over the rest."""
    for name in ("ranked", "firsts", "rounds", "placed", "results"):
        names = re.sub(rf"\b{name}\b", name + "2", names)
    return names.replace("FROM kept", "FROM rest")


_FOUND = """found AS (SELECT query_id, title, url, source_id, source_name, programming_language, place, round(score, 4) AS score FROM out1 UNION ALL
  SELECT query_id, title, url, source_id, source_name, programming_language, place + taken, round(score, 4) FROM results2)"""
_ALL = f"{b.SCORED}, {b.DIVERSE}, {_FUZZY}, {_again(b.DIVERSE)}, {_FOUND}"
_BOTH = f"{_ALL} SELECT query_id, title, url, source_id, programming_language, place, score FROM found"

#: After scored and passed (query_id, source_id): the search of what each query may see.
_WITHIN = f"""scored2 AS (SELECT s.* FROM scored s JOIN passed p USING (query_id, source_id)),
seen2 AS (SELECT * FROM scored2 QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY catalog_pos, pos) = 1),
kept2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, programming_language ORDER BY score DESC, title, url, catalog_pos, pos) AS lang_rank FROM seen2 QUALIFY
  lang_rank <= "limit"), {b.DIVERSE.replace("FROM kept)", "FROM kept2)")},
{_FUZZY.replace("FROM kept GROUP", "FROM kept2 GROUP").replace("JOIN scored USING", "JOIN scored2 USING").replace(
    "WHERE score > 0)", "WHERE score > 0 AND (query_id, source_id) IN (SELECT query_id, source_id FROM passed))")}, {_again(b.DIVERSE)}, {_FOUND}"""


def _search_sql(records: str) -> str:
    return f"WITH {records}, {b.REQUESTS}, {_BOTH}"


def _scored(spark, d):
    return s.score(s.match_exact(s.tokenized(b.requests(spark, d)), s.prepared(b.page_records(spark, d))))


def score_matches(spark, d):
    return _scored(spark, d).select("query_id", "pos", F.round("score", 4).alias("score"))


def dedupe(spark, d):
    return s.dedupe_matches(
        s.score(s.match_exact(s.tokenized(b.requests(spark, d)), s.prepared(b.document_records(spark, d))))
    ).select("query_id", "url", "pos")


def bounded(spark, d):
    return s.bounded_per_language(s.dedupe_matches(_scored(spark, d))).select("query_id", "url", "programming_language", "lang_rank")


def rank(spark, d):
    return s.ranked(s.dedupe_matches(_scored(spark, d))).select("query_id", "url", "rank")


def gate(spark, d):
    q = s.tokenized(b.requests(spark, d))
    kept = s.bounded_per_language(s.dedupe_matches(_scored(spark, d)))
    return s.fuzzy_gate(q, kept).select("query_id", "q")


def facets(spark, d):
    return s.facets(_scored(spark, d))


def tokenize(spark, d):
    return s.tokenized(b.requests(spark, d)).select("query_id", "q", F.concat_ws("|", F.array_sort("tokens")).alias("tokens"), "limit")


def fuzzy(spark, d):
    """Typos: the first two letters are swapped, in each query and in each of its words; the full search with both phases."""
    every = F.posexplode(F.concat(F.array("query"), F.split("query", " "))).alias("n", "query")
    asked = b.requests(spark, d).select("query_id", "limit", every).withColumn("query_id", F.col("query_id") * 10 + F.col("n"))
    swapped = F.concat(F.substring("query", 2, 1), F.substring("query", 1, 1), F.substring("query", 3, 1 << 20))
    found, _ = s.search(asked.withColumn("query", F.lower(swapped)), b.page_records(spark, d))
    return found.select(*_R, F.round("score", 4).alias("score"))


FUZZY = rf"""WITH {b.PAGE_RECORDS}, {b.REQUESTS.replace("requests AS", "requests2 AS")}, requests3 AS (SELECT query_id, "limit", list_prepend(query, string_split(query, ' ')) AS
  qs FROM requests2),
requests4 AS (SELECT query_id * 10 + unnest(range(len(qs))) AS query_id, "limit", unnest(qs) AS query FROM requests3),
requests AS (SELECT query_id, lower(substr(query, 2, 1) || substr(query, 1, 1) || substr(query, 3)) AS query, "limit" FROM requests4), {_BOTH}"""


def close_words(spark, d):
    """Words of the queries against all words of the documents' sentences."""
    words = s.prepared(b.document_records(spark, d)).select(F.explode(t.words_of(F.col("hay"))).alias("word"))
    tokens = s.tokenized(b.requests(spark, d)).select(F.explode("tokens").alias("token"))
    return s.close_words(tokens, words)


CLOSE_WORDS = rf"""WITH {b.DOCUMENT_RECORDS}, {b.REQUESTS}, tokens AS (SELECT DISTINCT unnest(string_split({b.normal_sql("query")}, ' ')) AS token FROM requests),
words AS (SELECT DISTINCT unnest(string_split_regex({b.normal_sql("title || ' ' || coalesce(section, '')")}, '[^\p{{L}}\p{{N}}]+')) AS word FROM records), {b.CLOSE}
  SELECT token, word, distance FROM close"""


def suggest(spark, d):
    return s.suggest(b.requests(spark, d), b.page_records(spark, d))


SUGGEST = f"""WITH {b.PAGE_RECORDS}, requests1 AS (SELECT item_id, string_split_regex(regexp_replace(text, '[^\\p{{L}}\\s]+', '', 'g'), '\\s+') AS w FROM benchmark),
requests AS (SELECT item_id AS query_id, concat_ws(' ', w[1], w[3]) AS query, 12 AS "limit" FROM requests1 WHERE length(concat_ws(' ', w[1], w[3])) >= 3), {_ALL},
  distinct_titles AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id, lower(title) ORDER BY place) = 1)
SELECT query_id, title, source_name, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM distinct_titles QUALIFY row_number() OVER (PARTITION BY query_id
  ORDER BY place) <= 8"""


def _sources(spark, d):
    return s.facets(_scored(spark, d)).select("query_id", "source_id", "source_name", "programming_language")


def _selections(spark, d):
    return b.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(
            F.col("item_id") % 3 == 0, F.array(F.lit("en"), F.lit("xx"))
        ).otherwise(F.array().cast("array<string>")).alias("language_ids"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en-com"), F.lit("de-net"))).otherwise(F.array(F.lit("gone"))).alias("source_ids")
    )


def filter_sources(spark, d):
    return r.filter_sources(_sources(spark, d), _selections(spark, d))


_FACETS = f"WITH {b.PAGE_RECORDS}, {b.REQUESTS}, {b.SCORED}, facets AS (SELECT DISTINCT query_id, source_id, source_name, programming_language FROM scored)"
_FILTERED = """, have AS (SELECT query_id, list(DISTINCT programming_language) AS ls, list(DISTINCT source_id) AS ids FROM facets GROUP BY query_id),
chosen AS (SELECT f.*, list_intersect(CASE WHEN f.query_id % 3 = 0 THEN ['en', 'xx'] ELSE []::VARCHAR[] END, ls) AS l, list_intersect(CASE WHEN f.query_id % 2 = 0 THEN
  ['en-com', 'de-net'] ELSE ['gone'] END, ids) AS i FROM facets f JOIN have USING (query_id)),
passed AS (SELECT query_id, source_id, source_name, programming_language FROM chosen WHERE (len(l) = 0 OR list_contains(l, programming_language)) AND (len(i) = 0 OR
  list_contains(i, source_id)))"""


def refine(spark, d):
    chosen = r.filter_sources(_sources(spark, d), _selections(spark, d))
    found, _ = s.refine(b.requests(spark, d), b.page_records(spark, d), chosen)
    return found.select("query_id", "url", "source_id", "place")


REFINE = f"{_FACETS}{_FILTERED}, {_WITHIN} SELECT query_id, url, source_id, place FROM found"


def run_requests(spark, d):
    """Requests for two sites in a locale; one index is faulty, some are not built."""
    records = b.page_records(spark, d)
    q = F.col("query_id")
    asked = b.requests(spark, d).withColumn(
        "docs_locale", F.element_at(F.array(F.lit("en"), F.lit("ja"), F.lit("")), (q % 3 + 1).cast("int"))
    ).withColumn("source_ids", F.array(F.lit("en-com"), F.lit("en-net"), F.lit("de-net")))
    manifest = records.groupBy("source_id", "docs_locale").agg(F.count("*").alias("record_count"), F.min("pos").alias("manifest_pos")).select(
        "*", F.when(F.col("source_id") == "de-net", "blocked").otherwise("supported").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.col("source_id").alias("path")
    )
    faults = manifest.where("source_id = 'en-net'").select("source_id", "docs_locale", F.lit("count").alias("reason"))
    out = run_request_tables(asked, manifest, records, faults)
    row = lambda kind, df, *c: df.select("query_id", F.lit(kind).alias("kind"), F.concat_ws("|", *c).alias("what"))
    parts = [
        row("record", out["records"], "url", F.col("place").cast("string")), row("facet", out["facets"], "source_id"),
        row("unavailable", out["unavailable"], "source_id", "status"), row("fallback", out["fallback"], "source_id", "actual_locale"),
        row("failed", out["failed"], "source_id", "reason")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


RUN = f"""WITH {b.PAGE_RECORDS}, {b.REQUESTS}, {b.SCORED}, passed AS (SELECT query_id, 'en-com' AS source_id FROM requests), {_WITHIN},
have AS (SELECT DISTINCT source_id FROM records WHERE source_id IN ('en-com', 'en-net', 'de-net')), asked AS (SELECT query_id, s AS source_id FROM requests, (VALUES
  ('en-com'), ('en-net'), ('de-net')) v(s))
SELECT query_id, 'record' AS kind, url || '|' || place AS what FROM found UNION ALL SELECT DISTINCT query_id, 'facet', source_id FROM (SELECT query_id, source_id FROM scored2
  UNION ALL SELECT query_id, source_id FROM near)
UNION ALL SELECT query_id, 'unavailable', source_id || '|' || CASE WHEN source_id = 'de-net' AND source_id IN (FROM have) THEN 'blocked' ELSE 'planned' END FROM asked
  WHERE source_id = 'de-net' OR source_id NOT IN (FROM have)
UNION ALL SELECT query_id, 'fallback', source_id || '|en' FROM asked WHERE query_id % 3 = 1 AND source_id <> 'de-net' AND source_id IN (FROM have) UNION ALL SELECT
  query_id, 'failed', source_id || '|count' FROM asked WHERE source_id = 'en-net' AND source_id IN (FROM have)"""


def _symbols(spark, d):
    """Results with symbol titles, out of parts: each query is a size, ranked by key."""
    p = b.table(spark, d, "part")
    title = F.when(
        F.col("p_partkey") % 5 == 0, F.concat(F.regexp_replace("p_name", " ", " :: "), F.lit("()"))
    ).when(F.col("p_partkey") % 5 == 1, F.regexp_replace("p_name", " ", ".")).when(F.col("p_partkey") % 5 == 4, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "::"))
    return p.select(
        (F.col("p_size") % 10).alias("query_id"), title.alias("title"), F.col("p_type").alias("source_id"),
        F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("ja").alias("docs_locale"),
        F.substring("p_brand", 1, 7).alias("programming_language"),
        F.when(F.col("p_partkey") % 13 == 0, "proposal").otherwise("reference").alias("document_kind"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("note "), "p_type")).alias("qualification"), F.col("p_partkey").alias("place")
    )


_SYMBOLS = rf"""symbols AS (SELECT p_size % 10 AS query_id, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', ' :: ') || '()' WHEN 1 THEN replace(p_name, ' ', '.') WHEN 4 THEN
  p_name ELSE replace(p_name, ' ', '::') END AS title, p_type AS source_id, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ja' END AS docs_locale,
 substr(p_brand, 1, 7) AS programming_language, CASE WHEN p_partkey % 13 = 0 THEN 'proposal' ELSE 'reference' END AS document_kind, CASE WHEN p_size % 3 = 0 THEN 'note '
  || p_type END AS qualification, p_partkey AS place FROM part),
keyed AS (SELECT *, CASE WHEN document_kind = 'reference' AND regexp_matches(title, '{r.SYMBOL}') THEN regexp_replace(regexp_replace(title, '{r.EMPTY_CALL}', ''),
  '{r.AROUND_MARK}', '\1', 'g') END AS key FROM symbols),
shared AS (SELECT *, key IS NOT NULL AND row_number() OVER (PARTITION BY query_id, programming_language, key, source_id, docs_locale ORDER BY place) = 1 AS joins FROM
  keyed),
grouped AS (SELECT *, CASE WHEN joins THEN min(place) OVER (PARTITION BY query_id, programming_language, key, joins) ELSE place END AS group_rank FROM shared)"""


def group_results(spark, d):
    return r.group_results(_symbols(spark, d)).select("query_id", "place", "group_rank", "member_rank")


def order_groups(spark, d):
    """Languages are named by seven times their number, so that order by value differs from that by letters."""
    grouped = r.group_results(_symbols(spark, d))
    number = (F.substring("id", 7, 1).cast("int") * 7).cast("string")
    names = grouped.select(F.col("programming_language").alias("id")).distinct().select("id", F.concat(F.lit("C"), number).alias("name"))
    return r.order_groups(grouped, "language-desc", names, collation=None).select("query_id", "place", "group_place")


def paginate(spark, d):
    return r.paginate(r.order_groups(r.group_results(_symbols(spark, d)))).select("query_id", "place", "page", "shown", "total")


def source_notes(spark, d):
    return r.source_notes(_symbols(spark, d))


def facet_choices(spark, d):
    return r.facet_choices(_sources(spark, d))


def query_log(spark, d):
    """User turns as raw queries with flags around them."""
    turns = b.table(spark, d, "conversations").where("role = 'user'")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    n = F.col("conv_id") % 6
    raw = F.when(n == 0, F.concat(F.lit("c++, go  "), F.array_join(words, " "))).when(n == 1, F.concat(F.lit("lang:py,js "), F.array_join(words, " "), F.lit(" locale:JA"))).when(
        n == 2, F.concat(F.get(words, F.lit(0)), F.lit(" lang:rust "), F.array_join(F.slice(words, 2, F.size(words)), " "))
    ).when(n == 3, F.lit("source:all locale:xx")).when(n == 4, F.concat(F.array_join(words, " "), F.lit(" source:official lang:go lang:rb"))).otherwise(F.array_join(words, "\t"))
    parsed = parse_query(
        turns.select("conv_id", "turn", raw.alias("raw"), F.array(*map(F.lit, ("cpp", "go", "python", "rust"))).alias("known_languages"))
    )
    return parsed.select(
        "conv_id", "turn", "search_text", F.array_join("languages", ",").alias("languages"), "locale", "source_mode",
        F.size("flags").alias("n_flags"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("errors")
    )


QUERY_LOG = r"""WITH turns AS (SELECT conv_id, turn, conv_id % 6 AS n, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN n = 2 THEN trim(coalesce(w[1], '') || ' lang:rust ' || array_to_string(w[2:], ' ')) WHEN n = 3 THEN '' ELSE trim(array_to_string(w, ' '))
  END AS search_text,
 CASE n WHEN 0 THEN 'cpp,go' WHEN 1 THEN 'python,javascript' WHEN 4 THEN 'go' ELSE '' END AS languages, CASE n WHEN 1 THEN 'ja' END AS locale, CASE n WHEN 3 THEN 'all'
  WHEN 4 THEN 'official' END AS source_mode,
 CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS n_flags, CASE n WHEN 2 THEN 'flag_in_search_text' WHEN 3 THEN
  'invalid_locale,empty_search_text' ELSE '' END AS errors FROM turns"""

_W = f"WITH {b.PAGE_RECORDS}, {b.REQUESTS}, {b.SCORED}"
QUERIES = {
    "search_pages": (_search(b.page_records, "broadcast"), _search_sql(b.PAGE_RECORDS)),
    "search_pages_trigrams": (_search(b.page_records, "trigrams"), _search_sql(b.PAGE_RECORDS)),
    "search_index": (search_index, _search_sql(b.PAGE_RECORDS)),
    "search_index_appended": (
        search_appended, f"WITH {b.PAGE_RECORDS}, {b.REQUESTS}, {_BOTH.replace('SELECT query_id, title, url, source_id, programming_language, place, score FROM found', '')} "
        "SELECT state, query_id, title, url, source_id, programming_language, place, score FROM found, (VALUES ('segments'), ('merged')) v(state)"
    ),
    "search_documents": (_search(b.document_records, "auto"), _search_sql(b.DOCUMENT_RECORDS)),
    "tokenize_queries": (tokenize, f"""WITH {b.REQUESTS} SELECT query_id, q, array_to_string(list_sort(list_distinct(string_split(q, ' '))), '|') AS tokens, "limit" FROM (SELECT query_id,
  {b.normal_sql("query")} AS q, "limit" FROM requests) WHERE q <> ''"""),
    "score_matches": (score_matches, f"{_W} SELECT query_id, pos, round(score, 4) AS score FROM scored"),
    "dedupe_matches": (dedupe, f"WITH {b.DOCUMENT_RECORDS}, {b.REQUESTS}, {b.SCORED} SELECT query_id, url, pos FROM seen"),
    "bounded_per_language": (bounded, f"{_W} SELECT query_id, url, programming_language, lang_rank FROM kept"),
    "rank_matches": (
        rank,
        f"{_W} SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, url, catalog_pos, pos) AS rank FROM seen"
    ),
    "fuzzy_gate": (gate, f"""{_W} SELECT q.query_id, q.q FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM kept GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) <
  least(q."limit", 12)"""),
    "search_facets": (
        facets,
        f"{_FACETS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY programming_language, source_name, source_id) AS place FROM facets"
    ),
    "search_fuzzy": (fuzzy, FUZZY),
    "close_words": (close_words, CLOSE_WORDS),
    "suggest": (suggest, SUGGEST),
    "filter_sources": (filter_sources, f"{_FACETS}{_FILTERED} SELECT * FROM passed"),
    "refine_search": (refine, REFINE),
    "run_requests": (run_requests, RUN),
    "facet_choices": (
        facet_choices,
        f"{_FACETS}, c AS (SELECT DISTINCT query_id, 'language' AS facet, programming_language AS value, programming_language AS label FROM facets UNION "
        f"SELECT DISTINCT query_id, 'site', source_id, source_name FROM facets) SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY "
        f"label, value) AS place FROM c QUALIFY count(*) OVER (PARTITION BY query_id, facet) > 1"
    ),
    "group_results": (
        group_results,
        f"WITH {_SYMBOLS} SELECT query_id, place, group_rank, row_number() OVER (PARTITION BY query_id, group_rank ORDER BY place) AS member_rank FROM grouped"
    ),
    "order_groups": (
        order_groups,
        f"WITH {_SYMBOLS} SELECT query_id, place, dense_rank() OVER (PARTITION BY query_id ORDER BY substr(programming_language, 7, 1)::INT DESC, "
        f"group_rank) AS group_place FROM grouped"
    ),
    "paginate_groups": (
        paginate,
        f"WITH {_SYMBOLS}, o AS (SELECT query_id, place, dense_rank() OVER (PARTITION BY query_id ORDER BY group_rank) AS g FROM grouped) SELECT "
        f"query_id, place, ((g - 1) // 15)::INT AS page, max(g) OVER (PARTITION BY query_id) AS total, least(((g - 1) // 15 + 1) * 15, max(g) OVER "
        f"(PARTITION BY query_id)) AS shown FROM o"
    ),
    "source_notes": (
        source_notes,
        f"WITH {_SYMBOLS}, f AS (SELECT query_id, source_id, arg_min(qualification, place) AS qualification, min(place) AS p FROM symbols WHERE "
        f"qualification IS NOT NULL GROUP BY ALL) SELECT query_id, source_id, qualification, row_number() OVER (PARTITION BY query_id ORDER BY p) AS "
        f"note_place FROM f"
    ),
    "parse_query_log": (query_log, QUERY_LOG),
}
