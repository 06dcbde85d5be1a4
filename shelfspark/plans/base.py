"""Tables that the registered queries derive from the given ones, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records of ``pages``: title element, path section, language by path, source by domain."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    tld = F.regexp_extract(host, r"([a-z]+)$", 1)
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.split_part(host, F.lit("."), F.lit(1)).alias("section"), lang.alias("programming_language"),
        lang.alias("docs_locale"), F.concat(lang, F.lit("-"), tld).alias("source_id"), F.concat(F.lit("Docs "), tld).alias("source_name"), F.when(tld == "org", "official").otherwise("community").alias("source_kind"),
        F.when(F.col("page_id") % 7 == 0, "proposal").otherwise("reference").alias("document_kind"), F.when(F.col("page_id") % 14 == 0, "stage-1").when(
            F.col("page_id") % 21 == 0, "withdrawn"
        ).alias("proposal_status"),
        F.when(tld == "com", 0).when(tld == "net", 1).otherwise(2).alias("catalog_pos"), F.col("page_id").alias("pos"),
    )


PAGE_RECORDS = r"""
recs0 AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url,
  '^https?://[^/]+/([a-z]+)/', 1) AS lang FROM pages),
recs1 AS (SELECT *, regexp_extract(host, '([a-z]+)$', 1) AS tld FROM recs0),
records AS (SELECT title, url, split_part(host, '.', 1) AS section, lang AS programming_language, lang AS docs_locale, lang || '-' || tld AS source_id, 'Docs ' || tld AS
  source_name,
  CASE WHEN tld = 'org' THEN 'official' ELSE 'community' END AS source_kind, CASE WHEN page_id % 7 = 0 THEN 'proposal' ELSE 'reference' END AS document_kind,
  CASE WHEN page_id % 14 = 0 THEN 'stage-1' WHEN page_id % 21 = 0 THEN 'withdrawn' END AS proposal_status, CASE tld WHEN 'com' THEN 0 WHEN 'net' THEN 1 ELSE 2 END AS
  catalog_pos, page_id AS pos FROM recs1)"""


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records of ``documents``: every sentence of every text is a title, language and source as given."""
    sentences = F.filter(F.transform(F.split("text", r"[.\n]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(sentences).alias("n", "title"))
    return rows.select(
        "title", F.concat(
            F.lit("https://docs.example/"), "lang", F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 400).cast("string")
        ).alias("url"), F.col("source").alias("section"),
        F.col("lang").alias("programming_language"), F.col("lang").alias("docs_locale"), F.col("source").alias("source_id"), F.upper("source").alias("source_name"),
        F.when(F.col("source").isin("src1", "src2"), "official").otherwise("conventional").alias("source_kind"),
        F.lit("reference").alias("document_kind"), F.lit(None).cast("string").alias("proposal_status"), F.substring("source", 4, 4).try_cast("int").alias("catalog_pos"), (
            F.col("doc_id") * 1_000_000 + F.col("n")
        ).alias("pos"),
    )


DOCUMENT_RECORDS = r"""
sentences AS (SELECT doc_id, lang, source, unnest(x) AS title, unnest(range(len(x))) AS n FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '[.\n]'),
  lambda x: trim(x)), lambda x: x <> '') AS x FROM documents)),
records AS (SELECT title, 'https://docs.example/' || lang || '/' || source || '/' || (doc_id % 400) AS url, source AS section, lang AS programming_language, lang AS
  docs_locale,
  source AS source_id, upper(source) AS source_name, CASE WHEN source IN ('src1', 'src2') THEN 'official' ELSE 'conventional' END AS source_kind, 'reference' AS
  document_kind, NULL::VARCHAR AS proposal_status,
  try_cast(substr(source, 4, 4) AS INT) AS catalog_pos, doc_id * 1000000 + n AS pos FROM sentences)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of queries: two words of each benchmark item."""
    words = F.split(F.regexp_replace("text", r"[^\p{L}\s]+", ""), r"\s+")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(2))).alias("query"),
        (F.col("item_id") % 9 + 2).cast("int").alias("limit")
    )


REQUESTS = r"""
requests0 AS (SELECT item_id, string_split_regex(regexp_replace(text, '[^\p{L}\s]+', '', 'g'), '\s+') AS w, item_id % 9 + 2 AS "limit" FROM benchmark),
requests AS (SELECT item_id AS query_id, concat_ws(' ', w[1], w[3]) AS query, "limit" FROM requests0)"""


def normal_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def osa_sql(a: str, b: str) -> str:
    """Whether two strings are within one edit or, from eight characters of the first on, two: DuckDB's distance also counts an
    insertion between swapped neighbours, which is a third edit here, so a swap with an insertion or deletion is looked at."""
    apart = f"len(list_filter(range(1, length({a})), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 AND substr({b}, j, 1) = substr({a}, i + 1, 1) AND substr({b}, j + 1, 1) = substr({a}, i, 1) AND levenshtein(substr({a}, 1, i - 1), substr({b}, 1, j - 1)) + levenshtein(substr({a}, i + 2), substr({b}, j + 2)) <= 1)) > 0)) > 0"
    return (
        f"CASE WHEN damerau_levenshtein({a}, {b}) < 2 THEN damerau_levenshtein({a}, {b}) WHEN damerau_levenshtein({a}, {b}) = 2 AND length({a}) >= 8 AND "
        f"(levenshtein({a}, {b}) = 2 OR length({a}) = length({b}) OR {apart}) THEN 2 END"
    )


def one_byte_sql(c: str) -> str:
    """DuckDB's distances count bytes; lower-case words have no capitals, so these stand for the letters of more bytes."""
    return f"translate({c}, 'àâäáçéèêëíîïñóôöœßúùûüÿ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


#: From tokens (token) and words (word): close pairs by comparing all of the right lengths.
CLOSE = rf"""
close0 AS (SELECT token, word, {one_byte_sql("token")} AS a, {one_byte_sql("word")} AS b FROM (SELECT DISTINCT token FROM tokens) JOIN (SELECT DISTINCT word FROM words)
  ON abs(length(word) - length(token)) <= CASE WHEN length(token) >= 8 THEN 2 ELSE 1 END AND (length(token) >= 7 OR length(word) = length(token))
  WHERE length(token) >= 4 AND length(word) >= 4 AND regexp_full_match(token, '[\p{{L}}\p{{N}}]+') AND regexp_full_match(word, '[\p{{L}}\p{{N}}]+') AND
  damerau_levenshtein({one_byte_sql("token")}, {one_byte_sql("word")}) <= 2),
close AS (SELECT * FROM (SELECT token, word, {osa_sql("a", "b")} AS distance FROM close0) WHERE distance IS NOT NULL)"""


#: From records and requests: all scored exact matches, with normalised columns.
SCORED = rf"""
queries AS (SELECT *, list_distinct(string_split(q, ' ')) AS toks FROM (SELECT query_id, {normal_sql("query")} AS q, "limit" FROM requests) WHERE q <> ''),
hay AS (SELECT *, trim(t || ' ' || s) AS hay FROM (SELECT *, {normal_sql("title")} AS t, {normal_sql("coalesce(section, '')")} AS s FROM records)),
pairs AS (SELECT * FROM hay JOIN queries ON len(list_filter(toks, lambda x: NOT contains(hay, x))) = 0),
scored AS (SELECT * FROM (SELECT *, 40.0::DOUBLE + CASE WHEN t = q THEN 100 WHEN starts_with(t, q) THEN 75 WHEN contains(t, q) THEN 55 ELSE 0 END
  + list_sum(list_transform(toks, lambda x: CASE WHEN t = x THEN 30 WHEN starts_with(t, x) THEN 20 WHEN contains(t, x) THEN 12 WHEN contains(s, x) THEN 4 ELSE 0 END))
  + CASE WHEN source_kind = 'official' THEN 5 ELSE 0 END - CASE WHEN document_kind = 'proposal' THEN 12 ELSE 0 END
  - CASE WHEN regexp_matches(coalesce(proposal_status, ''), '(?i)withdrawn|rejected|superseded|inactive|deferred') THEN 8 WHEN regexp_matches(coalesce(proposal_status,
  ''), '(?i)draft|candidate|submitted|stage-[01](\D|$)') THEN 4 ELSE 0 END
  - least(length(t) / 100.0::DOUBLE, 5) AS score FROM pairs) WHERE score > 0),
seen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY catalog_pos, pos) = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, programming_language ORDER BY score DESC, title, url, catalog_pos, pos) AS lang_rank FROM seen QUALIFY
  lang_rank <= "limit")"""

DIVERSE = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, url, catalog_pos, pos) AS rank, lang_rank - 1 AS k FROM kept),
firsts AS (SELECT *, min(rank) OVER (PARTITION BY query_id, programming_language) AS f, count(*) OVER (PARTITION BY query_id ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) AS before FROM ranked),
rounds AS (SELECT *, CASE WHEN k < 3 AND before < "limit" THEN k ELSE 3 END AS rnd FROM firsts),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rnd, CASE WHEN rnd < 3 THEN f ELSE rank END) AS place FROM rounds),
results AS (SELECT * FROM placed WHERE rnd < 3 OR place <= "limit")"""


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A catalog out of regions (languages), nations (sources) and suppliers (indexes)."""
    languages = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("catalog_pos"), F.lower("r_name").alias("id"), F.col("r_name").alias("name"),
        F.array(F.concat(F.lit("r"), F.col("r_regionkey"))).alias("aliases"), F.array().cast("array<string>").alias("bare_aliases"),
        (F.col("r_regionkey") % 2 == 0).alias("auto_non_official_fallback")
    )
    aliases = languages.select(
        "catalog_pos", F.col("id").alias("language_id"), F.explode(F.concat(F.array("id"), F.col("aliases"))).alias("alias")
    )
    key = F.col("n_nationkey")
    sources = table(spark, sf_dir, "nation").join(F.broadcast(languages.select("catalog_pos", "id")), F.col("n_regionkey") == F.col("catalog_pos")).select(
        "catalog_pos", key.alias("source_pos"), F.col("id").alias("language_id"), F.lower("n_name").alias("source_id"), F.element_at(
            F.array(F.lit("official"), F.lit("conventional"), F.lit("community")), (key % 3 + 1).cast("int")
        ).alias("source_kind"), F.lit("reference").alias("document_kind"), F.col("n_name").alias("source_name"),
        F.concat(
            F.lit("https://"), F.lower("n_name"), F.lit(".example/")
        ).alias("url"), F.when(key % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lower("n_name"), F.lit(".example")))).alias("domains"), F.array().cast("array<string>").alias("path_prefixes"),
        F.when(key % 2 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("ja"))).alias("site_locales"), F.lit(True).alias("default_enabled"), F.when(key % 4 == 0, "unofficial").alias("qualification"), F.when(key % 8 == 0, "x").alias("qualification_ja"),
    )
    s = F.col("s_suppkey")
    place = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.lower("n_name").alias("source_id"), F.col("n_regionkey").alias("catalog_pos"),
        F.col("n_nationkey").alias("source_pos")
    )
    indexes = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "catalog_pos", "source_pos", s.alias("index_pos"), "source_id",
        F.element_at(F.array(*map(F.lit, ("en", "ja", "de"))), (s % 3 + 1).cast("int")).alias("docs_locale"),
        F.element_at(F.array(*map(F.lit, ("supported", "supported", "planned", "blocked"))), (s % 4 + 1).cast("int")).alias("status"),
        F.when(s % 8 == 3, "licence").alias("reason")
    )
    return {"languages": languages, "language_aliases": aliases, "sources": sources, "source_indexes": indexes}


CATALOG = """
languages AS (SELECT r_regionkey AS catalog_pos, lower(r_name) AS id, r_name AS name, 'r' || r_regionkey AS alias1, r_regionkey % 2 = 0 AS auto_fb FROM region),
aliases AS (SELECT catalog_pos, id AS language_id, id AS alias FROM languages UNION ALL SELECT catalog_pos, id, alias1 FROM languages),
sources AS (SELECT catalog_pos, n_nationkey AS source_pos, id AS language_id, lower(n_name) AS source_id, (['official', 'conventional', 'community'])[n_nationkey % 3 +
  1] AS source_kind, n_name AS source_name,
  CASE WHEN n_nationkey % 6 = 5 THEN []::VARCHAR[] ELSE [lower(n_name) || '.example'] END AS domains, CASE WHEN n_nationkey % 2 = 0 THEN ['en'] ELSE ['en', 'ja'] END AS
  site_locales,
  CASE WHEN n_nationkey % 4 = 0 THEN 'unofficial' END AS qualification, CASE WHEN n_nationkey % 8 = 0 THEN 'x' END AS qualification_ja FROM nation JOIN languages ON
  n_regionkey = catalog_pos),
indexes AS (SELECT n_regionkey AS catalog_pos, n_nationkey AS source_pos, s_suppkey AS index_pos, lower(n_name) AS source_id, (['en', 'ja', 'de'])[s_suppkey % 3 + 1] AS
  docs_locale,
  (['supported', 'supported', 'planned', 'blocked'])[s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 8 = 3 THEN 'licence' END AS reason FROM supplier JOIN nation ON
  s_nationkey = n_nationkey)"""


def snapshot(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """A manifest of a build: events by type and user, of the first or the second slice of events."""
    e = table(spark, sf_dir, "events")
    rows = e.where(F.col("event_id") % 2 == part).where((F.col("user_id") % 11 != part))
    return rows.groupBy(F.col("event_type").alias("source_id"), (F.col("user_id") % 13).cast("string").alias("docs_locale")).agg(
        F.count("*").alias("record_count"), F.sum((F.col("value") * 100).cast("long")).alias("gzip_bytes"),
        F.max("event_id").cast("string").alias("output_sha256")
    )


def snapshot_sql(part: int) -> str:
    return (
        f"(SELECT event_type AS source_id, (user_id % 13)::VARCHAR AS docs_locale, count(*) AS record_count, sum(trunc(value * 100)::BIGINT)::BIGINT AS "
        f"gzip_bytes, max(event_id)::VARCHAR AS output_sha256 FROM events WHERE event_id % 2 = {part} AND user_id % 11 <> {part} GROUP BY ALL)"
    )
