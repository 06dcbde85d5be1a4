"""Batch search: a table of requests against a table of records.

records: title, url, section, programming_language, docs_locale, source_id, source_name, source_kind, document_kind,
proposal_status, catalog_pos, pos; or an index that was built of them (``index.open_index``). requests: query_id, query and
optionally limit.

Every token of a query must be contained in a record's title and section. ``plan="broadcast"`` looks for each query in each
record, a batch of records at a time: no shuffle of records, for up to ``MOST_BROADCAST`` queries and records of any number.
``plan="trigrams"`` joins on one trigram of each query, the rarest, since a record that contains a token contains its trigrams;
queries whose tokens are all shorter join on a run of one or two characters. Both give the same rows; ``auto`` counts and
chooses. Over an index the postings are read, and records only where a candidate is.

With typos, only the part of a query that the fewest records have makes candidates: the records that contain that token or have
a word close to it. The other tokens are then looked for in each candidate, so work grows with the rarest token of a query.

A search writes the normalised records once, and the scored matches once; later steps read the columns they need. What it wrote
on the way is removed when its results are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import parts as looked
from ..functions.text import DRAFT_LIKE, NOT_CURRENT, normalize_text, tokens_of, words_of
from ..shared import cut, settled_all, sized, spread

# Weights of the score, and limits.
BASE, EQUAL, STARTS, CONTAINS = 40.0, 100.0, 75.0, 55.0
TOKEN_EQUAL, TOKEN_STARTS, TOKEN_CONTAINS, TOKEN_SECTION = 30.0, 20.0, 12.0, 4.0
PER_DISTANCE, OFFICIAL, PROPOSAL, DEAD, DRAFT, LENGTH, MOST_LENGTH = 18.0, 5.0, 12.0, 8.0, 4.0, 100.0, 5.0
LEAST_EXACT, ROUNDS = 12, 3
RUNTIME_LIMIT, LIBRARY_LIMIT, SUGGEST_LIMIT, SUGGESTIONS, SUGGEST_CHARS = 60, 50, 12, 8, 3

MOST_BROADCAST, GRAM = 2_000, 3

#: Keys of tokens that are broadcast to the words, and runs near a token that are sent to each task.
MOST_KEYS, MOST_NEAR = 500_000, 100_000

#: Tokens up to this number are held against the letters of each word.
MOST_COMPARED = 1_000

#: Columns that a scope may name, which postings carry.
SCOPE = ("source_id", "docs_locale")


def prepared_columns(records: DataFrame) -> DataFrame:
    """Records with a number ``_row`` and normalised ``t`` (title), ``s`` (section) and ``hay`` (both)."""
    rows = records.withColumns({"t": normalize_text(F.col("title")), "s": normalize_text(F.coalesce("section", F.lit("")))})
    return rows.withColumns({"hay": F.trim(F.concat_ws(" ", "t", "s")), "_row": F.monotonically_increasing_id()})


def prepared(records: DataFrame) -> DataFrame:
    """The prepared columns, written once, in as many files as there are cores at least: each later step reads them again."""
    return cut(prepared_columns(spread(records)))


def tokenized(requests: DataFrame, limit: int = RUNTIME_LIMIT) -> DataFrame:
    """(query_id, q, tokens, limit) of requests with a token."""
    given = F.coalesce("limit", F.lit(limit)) if "limit" in requests.columns else F.lit(limit)
    rows = requests.select("query_id", normalize_text(F.coalesce("query", F.lit(""))).alias("q"), given.cast("int").alias("limit"))
    return rows.withColumn("tokens", tokens_of(F.col("q"))).where(F.size("tokens") > 0)


def _grams(c: Column, size: Column | int) -> Column:
    """Distinct runs of so many characters, in one pass over texts of any length."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.regexp_extract_all(c, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))."))))


class Scanned:
    """Postings of prepared records, worked out when they are asked for."""

    def __init__(self, rows: DataFrame):
        self.rows, self._runs = rows, None

    def grams(self, wanted: DataFrame) -> DataFrame:
        """(gram, _row, SCOPE) of the distinct grams in ``wanted``."""
        sizes = [r["size"] for r in wanted.select(F.length("gram").alias("size")).distinct().collect()]  # three at most
        every = F.concat(F.array().cast("array<string>"), *(_grams(F.col("hay"), n) for n in sizes))
        return self.rows.select("_row", *self._scope(), F.explode(every).alias("gram")).join(wanted, "gram", "left_semi")

    def gram_counts(self, wanted: DataFrame) -> DataFrame:
        """(gram, n) of the distinct grams in ``wanted``."""
        return self.grams(wanted).groupBy("gram").agg(F.count("*").alias("n"))

    def words(self, wanted: DataFrame) -> DataFrame:
        """(word, _row) of the distinct words in ``wanted``."""
        return self.rows.select("_row", F.explode(words_of(F.col("hay"))).alias("word")).join(wanted, "word", "left_semi")

    def runs(self) -> DataFrame:
        """(run) of the distinct runs between spaces, written once: some hundredths of the text, and no word goes beyond one."""
        if self._runs is None:
            self._runs = cut(self.rows.select("hay").mapInArrow(looked.runs, "run string").distinct())
        return self._runs

    def vocabulary(self) -> DataFrame:
        """All words."""
        return self.runs().select(F.explode(words_of(F.col("run"))).alias("word")).distinct()

    def near(self, close: DataFrame) -> DataFrame:
        """(run, token, distance) of the runs with a word close to a token."""
        words = self.runs().select("run", F.explode(words_of(F.col("run"))).alias("word"))
        return words.join(F.broadcast(close), "word").groupBy("run", "token").agg(F.min("distance").alias("distance"))

    def records(self, wanted: DataFrame) -> DataFrame:
        """The prepared records of the rows in ``wanted``, with its columns."""
        return wanted.join(self.rows, "_row")

    def _scope(self) -> list[str]:
        return [c for c in SCOPE if c in self.rows.columns]


def _plan(needles: DataFrame, plan: str) -> str:
    if plan != "auto":
        return plan
    return "broadcast" if needles.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else "trigrams"


def _held(needles: DataFrame, key: str, parts: str, near: list | None = None) -> Callable[[str], Column]:
    """A function of a text column: the keys of all needles whose parts a text contains. With ``near``, (run, part, distance), a
    part may be near a run between spaces, and keys stand with the distances of their parts. Needles are few and are sent to
    each task."""
    asked = [(r[0], r[1]) for r in needles.select(key, parts).distinct().collect()]
    numbers = {p: i for i, p in enumerate(dict.fromkeys(p for _, ps in asked for p in ps))}
    wanted = [[numbers[p] for p in ps] for _, ps in asked]
    kind = needles.schema[key].dataType
    keys = pa.array([k for k, _ in asked], to_arrow_type(kind))
    around = None if near is None else (
        pa.array([r[0] for r in near], pa.string()), np.array([numbers[r[1]] for r in near], np.int64), np.array([r[2] for r in near], np.int64)
    )
    rows = min(looked.ROWS, looked.CELLS // (len(numbers) + 1))
    to = kind if near is None else StructType().add("key", kind).add("found", ArrayType(IntegerType()))

    @F.arrow_udf(ArrayType(to))
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in looked.gathered(batches, rows):
            of = looked.distances(texts, list(numbers), around)
            met = [np.flatnonzero((of[w] != looked.NONE).all(axis=0)) for w in wanted] 
            if near is None:
                yield looked.lists(met, keys, len(texts))
                continue
            found = pa.array([d for w, m in zip(wanted, met) for d in of[np.ix_(w, m)].T.tolist()], pa.list_(pa.int32()))
            named = keys.take(pa.array(np.repeat(np.arange(len(wanted)), [len(m) for m in met])))
            yield looked.lists(met, pa.StructArray.from_arrays([named, found], ["key", "found"]), len(texts), apart=True)

    return held


def _equal(same: dict[str, str] | None) -> Column:
    out = F.lit(True)
    for of_row, of_needle in (same or {}).items():
        out = out & (F.col(of_row) == F.col(of_needle))
    return out


def _asked(needles: DataFrame, key: str, parts: str) -> DataFrame:
    """(key, gram) of the runs of characters that a row with all parts has: of three, or of as many as the longest part has."""
    size = F.least(F.lit(GRAM), F.array_max(F.transform(parts, F.length)))
    grams = F.array_distinct(F.flatten(F.transform(parts, lambda p: _grams(p, F.col("size")))))
    return needles.select(key, parts).distinct().withColumn("size", size).select(key, F.explode(grams).alias("gram"))


def rarest(needles: DataFrame, postings: Scanned, key: str, parts: str) -> DataFrame:
    """(key, gram, n): the gram of each needle that the fewest rows have."""
    asked = cut(_asked(needles, key, parts))
    counted = postings.gram_counts(asked.select("gram").distinct())
    cost = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))
    return asked.join(counted, "gram", "left").groupBy(key).agg(F.min(cost).alias("of")).select(key, "of.gram", "of.n")


def _looked_for(needles: DataFrame, rows: DataFrame, key: str, parts: str, same: dict[str, str] | None, near: list | None = None) -> DataFrame:
    """Pairs of needles, which are broadcast, and rows that hold their parts; with ``near`` also ``distances`` by part."""
    met = rows.withColumn("_met", F.explode(_held(needles, key, parts, near)("hay")))
    of = F.col("_met") if near is None else F.col("_met.key")
    pairs = met.join(F.broadcast(needles), of.eqNullSafe(F.col(key)) & _equal(same))
    return (pairs if near is None else pairs.withColumn("distances", F.map_from_arrays(parts, "_met.found"))).drop("_met")


def contained(
    needles: DataFrame, rows: DataFrame | None, key: str, parts: str, plan: str = "auto", same: dict[str, str] | None = None,
    postings: Scanned | None = None,
) -> DataFrame:
    """Pairs of needles and rows (of prepared records) whose ``hay`` contains all the strings in the needle's ``parts``, and
    that are equal in the columns ``same`` (of rows: of needles). ``key`` tells different parts apart."""
    fits = F.forall(parts, lambda p: F.contains("hay", p)) & _equal(same)
    if rows is not None and _plan(needles, plan) == "broadcast":
        return _looked_for(needles, rows, key, parts, same)
    postings = postings or Scanned(rows)
    found = cut(rarest(needles, postings, key, parts))
    # The columns of ``same`` are keys of the join where postings have them.
    held = {r: n for r, n in (same or {}).items() if r in SCOPE}
    meant = needles.select(key, *held.values()).distinct().join(found, key)
    met = postings.grams(found.select("gram").distinct()).withColumnRenamed("gram", "of_gram").join(meant, (F.col("of_gram") == F.col("gram")) & _equal(held))
    # A row has a gram once, and a needle one gram: the pairs are distinct.
    return postings.records(met.select("_row", key)).join(needles, key).where(fits)


def match_exact(
    queries: DataFrame, rows: DataFrame | None, plan: str = "auto", same: dict[str, str] | None = None, postings: Scanned | None = None
) -> DataFrame:
    """Pairs of tokenized queries and prepared records that hold all tokens."""
    return contained(queries, rows, "query_id", "tokens", plan, same, postings)


# Typos -----------------------------------------------------------------------------------------------------------


def _swapped(a: Column, i: Column) -> Column:
    """The string with the characters at i and i + 1 in each other's place."""
    return F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))


def osa_distance(a: Column, b: Column, most: int) -> Column:
    """Up to ``most`` (1 or 2) inserted, deleted or replaced characters or swapped neighbours, none touched twice, that lead
    from a to b; null if it takes more. Plain edits are Spark's own distance. A swap cuts both strings in two parts before and
    after it, and what is left for these decides: nothing, one edit, or one more swap."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    rest = lambda c, i: F.substring(c, i + 2, F.length(c))
    after_swap = F.exists(places, lambda i: (F.length(a) > 1) & (_swapped(a, i) == b))
    plain = F.levenshtein(a, b, most)
    if most == 1:
        return F.when(plain >= 0, plain).when(after_swap, 1)

    def one_edit(i: Column) -> Column:
        pair = lambda j: (j >= 1) & (
            F.substring(b, j, F.lit(1)) == F.substring(a, i + 1, F.lit(1))
        ) & (F.substring(b, j + 1, F.lit(1)) == F.substring(a, i, F.lit(1)))
        left = lambda j: F.levenshtein(F.left(a, i - 1), F.left(b, j - 1)) + F.levenshtein(rest(a, i), rest(b, j))
        return F.exists(F.array(i - 1, i, i + 1), lambda j: pair(j) & (left(j) <= 1))

    two_swaps = F.exists(places, lambda i: F.exists(places, lambda j: (j >= i + 2) & (_swapped(_swapped(a, i), j) == b)))
    return F.when(
        F.length(a) < 2, F.when(plain >= 0, plain)
    ).when(plain.between(0, 1), plain).when(after_swap, 1).when(plain == 2, 2).when(F.exists(places, one_edit) | two_swaps, 2)


def _without_one(word: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word)))
    )


def _deletions(word: Column, most: int) -> Column:
    """The word and what is left of it after up to ``most`` deletions: close words share one."""
    level = F.array(word)
    every = level
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def _like(tokens: list[tuple[str, int]]) -> Callable[[str], Column]:
    """A function of a word column: (token, most) of the tokens that are up to ``most`` edits away."""
    values = pa.StructArray.from_arrays([pa.array([t for t, _ in tokens], pa.string()), pa.array([m for _, m in tokens], pa.int32())], ["token", "most"])

    @F.arrow_udf("array<struct<token:string,most:int>>")
    def like(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in looked.gathered(batches):
            words = looked.Words(some)
            yield looked.lists([words.near(t, most) for t, most in tokens], values, len(some))

    return like


def close_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, distance): close pairs of distinct tokens and words. Few tokens are compared with the words of about their
    length and letters, many meet them by shared deletions; both then are verified."""
    plain = F.lit(r"^[\p{L}\p{N}]+$")
    t = tokens.select("token").distinct().where((F.length("token") >= 4) & F.rlike("token", plain)).withColumn(
        "most", F.when(F.length("token") >= 8, 2).otherwise(1)
    )
    v = words.select("word").distinct().where((F.length("word") >= 4) & F.rlike("word", plain))
    lengths = (F.abs(F.length("word") - F.length("token")) <= F.col("most")) & (
        (F.length("token") >= 7) | (F.length("word") == F.length("token"))
    )
    sizes = t.select("most", F.length("token").alias("size")).distinct().collect()
    # Only words of a length that some token may reach have their deletions made.
    reach = {m: sorted({r["size"] + d for r in sizes if r["most"] == m for d in range(-m, m + 1)}) for m in (1, 2)}
    v = v.where(F.length("word").isin(sorted({*reach[1], *reach[2]})))
    few = t.limit(MOST_COMPARED + 1).collect()
    if len(few) <= MOST_COMPARED:
        pairs = v.withColumn("of", F.explode(_like([(r["token"], r["most"]) for r in few])("word"))).select("of.token", "of.most", "word")
        far = lambda m: F.when(F.col("most") == m, osa_distance(F.col("token"), F.col("word"), m))
        return pairs.where(lengths).select("token", "word", F.coalesce(far(1), far(2)).alias("distance")).where("distance is not null")
    v = cut(v)
    parts = []
    for most, reached in reach.items():
        own = t.where(F.col("most") == most)
        left = cut(own.select("token", "most", F.explode(_deletions(F.col("token"), most)).alias("key")))
        right = v.where(F.length("word").isin(reached)).select("word", F.explode(_deletions(F.col("word"), most)).alias("key"))
        pairs = right.join(sized(left, left.count(), MOST_KEYS), "key").where(lengths).select("token", "word").distinct()
        parts.append(pairs.withColumn("distance", osa_distance(F.col("token"), F.col("word"), most)))
    return parts[0].unionByName(parts[1]).where("distance is not null")


def fuzzy_candidates(
    queries: DataFrame, rows: DataFrame | None, close: DataFrame, plan: str = "auto", postings: Scanned | None = None
) -> DataFrame:
    """(query_id, _row): for each query the rows that contain its cheapest token or have a word close to it. A token costs the
    rows of its close words, and those that contain it, or one of its grams, to which they are bounded."""
    postings = postings or Scanned(rows)
    asked = cut(queries.select("query_id", F.explode("tokens").alias("token")).distinct())
    tokens = asked.select("token").distinct().withColumn("parts", F.array("token"))
    if rows is not None and _plan(tokens, plan) == "broadcast":
        inside = rows.select(F.explode(_held(tokens, "token", "parts")("hay")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    else:
        inside = rarest(tokens, postings, "token", "parts").select("token", "n")
    by_word = cut(postings.words(close.select("word").distinct()))
    around = close.join(by_word.groupBy("word").agg(F.count("*").alias("n")), "word").select("token", "n")
    cost = inside.unionByName(around).groupBy("token").agg(F.sum("n").alias("n"))
    cheapest = asked.join(cost, "token", "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("of")
    ).select("query_id", "of.token")
    cheapest = cut(cheapest)
    picked = tokens.join(cheapest, "token", "left_semi")
    near = close.join(picked, "token", "left_semi").join(by_word, "word").select("token", "_row")
    found = contained(picked, rows, "token", "parts", plan, None, postings).select("token", "_row").unionByName(near).distinct()
    return found.join(cheapest, "token").select("query_id", "_row")


def match_fuzzy(
    queries: DataFrame, rows: DataFrame | None, plan: str = "auto", same: dict[str, str] | None = None, postings: Scanned | None = None
) -> DataFrame:
    """Pairs where each token is contained (distance 0) or close to a word, with ``distances`` by token. Close words are worked
    out between distinct tokens and words; candidates come from each query's cheapest token, and its other tokens are looked for
    in their words."""
    postings = postings or Scanned(rows)
    tokens = queries.select(F.explode("tokens").alias("token")).distinct()
    close = cut(close_words(tokens, postings.vocabulary()))
    if rows is not None and _plan(queries, plan) == "broadcast":
        near = postings.near(close).limit(MOST_NEAR + 1).collect()
        if len(near) <= MOST_NEAR:
            return _looked_for(queries, rows, "query_id", "tokens", same, near)
    met = fuzzy_candidates(queries, rows, close, plan, postings)
    # What is close to each token of a query: some words each.
    by_token = close.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("word", "distance"))).alias("close"))
    asked = queries.select("query_id", F.explode("tokens").alias("token")).distinct().join(by_token, "token")
    near = asked.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "close"))).alias("near"))
    known = queries.join(near, "query_id", "left")
    words = words_of(F.col("hay"))

    def distance(x: Column) -> Column:
        around = F.try_element_at("near", x)
        return F.when(F.contains("hay", x), 0).otherwise(F.array_min(F.transform("words", lambda w: F.try_element_at(around, w))))

    full = postings.records(met).withColumn("words", words).join(known, "query_id").where(_equal(same))
    full = full.withColumn("found", F.transform("tokens", distance)).where(~F.exists("found", F.isnull))
    return full.withColumn("distances", F.map_from_arrays("tokens", "found")).drop("found", "words", "near")


# Scores and ranks ------------------------------------------------------------------------------------------------


def score(pairs: DataFrame) -> DataFrame:
    """Pairs with a positive ``score``; ``distances`` counts if there."""
    t, s, q = F.col("t"), F.col("s"), F.col("q")
    whole = F.when(t == q, EQUAL).when(F.startswith(t, q), STARTS).when(F.contains(t, q), CONTAINS).otherwise(0.0)
    token = lambda x: F.when(t == x, TOKEN_EQUAL).when(F.startswith(t, x), TOKEN_STARTS).when(F.contains(t, x), TOKEN_CONTAINS).when(F.contains(s, x), TOKEN_SECTION).otherwise(0.0)
    total = F.lit(BASE) + whole + F.aggregate("tokens", F.lit(0.0), lambda a, x: a + token(x))
    if "distances" in pairs.columns:
        total = total - PER_DISTANCE * F.aggregate(F.map_values("distances"), F.lit(0.0), lambda a, x: a + x)
    status = F.coalesce("proposal_status", F.lit(""))
    total = total + F.when(F.col("source_kind") == "official", OFFICIAL).otherwise(0.0) - F.when(
        F.col("document_kind") == "proposal", PROPOSAL
    ).otherwise(0.0)
    total = total - F.when(F.rlike(status, F.lit(NOT_CURRENT)), DEAD).when(F.rlike(status, F.lit(DRAFT_LIKE)), DRAFT).otherwise(0.0)
    return pairs.withColumn("score", total - F.least(F.length("t") / LENGTH, F.lit(MOST_LENGTH))).where("score > 0")


def _order(collation: str | None) -> list[Column]:
    name = (lambda c: F.collate(F.col(c), collation)) if collation else F.col
    return [F.col("score").desc(), name("title"), name("url"), F.col("catalog_pos"), F.col("pos")]


def first_in_order(scored: DataFrame, *by: str) -> DataFrame:
    """One row for each of the columns' values, the first in scan order."""
    scan = w.Window.partitionBy(*by).orderBy("catalog_pos", "pos")
    return scored.withColumn("_n", F.row_number().over(scan)).where("_n = 1").drop("_n")


def dedupe_matches(scored: DataFrame) -> DataFrame:
    """One row for each query and URL, the first in scan order."""
    return first_in_order(scored, "query_id", "url")


def bounded_per_language(scored: DataFrame, collation: str | None = None) -> DataFrame:
    """The best ``limit`` of each query and language. Spark keeps the first rows of a group before the shuffle."""
    top = w.Window.partitionBy("query_id", "programming_language").orderBy(*_order(collation))
    return scored.withColumn("lang_rank", F.row_number().over(top)).where(F.col("lang_rank") <= F.greatest("limit", F.lit(0)))


def ranked(scored: DataFrame, collation: str | None = None) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(w.Window.partitionBy("query_id").orderBy(*_order(collation))))


def diversify(scored: DataFrame, collation: str | None = None, limit: str = "limit") -> DataFrame:
    """``place`` in a result that shows every language early: up to three rounds take the next best of each language, in the
    order of their best, as long as the result is under the limit when a round starts; the rest follows by rank up to the limit."""
    by_query, by_lang = w.Window.partitionBy("query_id"), w.Window.partitionBy("query_id", "programming_language")
    rows = ranked(scored, collation).withColumn(
        "_k", F.row_number().over(by_lang.orderBy("rank")) - 1
    ).withColumn("_first", F.min("rank").over(by_lang))
    before = F.coalesce(F.count("*").over(by_query.orderBy("_k").rangeBetween(w.Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_round", F.when((F.col("_k") < ROUNDS) & (before < F.col(limit)), F.col("_k")).otherwise(ROUNDS))
    in_order = by_query.orderBy("_round", F.when(F.col("_round") < ROUNDS, F.col("_first")).otherwise(F.col("rank")))
    rows = rows.withColumn("place", F.row_number().over(in_order))
    return rows.where((F.col("_round") < ROUNDS) | (F.col("place") <= F.col(limit))).drop("_k", "_first", "_round")


def facets(matches: DataFrame, collation: str | None = None) -> DataFrame:
    """(query_id, source_id, source_name, programming_language, place) of the sources of all matches, before any limit."""
    first = matches.groupBy("query_id", "source_id").agg(
        F.min_by(F.struct("source_name", "programming_language"), F.struct("catalog_pos", "pos")).alias("of")
    )
    name = (lambda c: F.collate(F.col(c), collation)) if collation else F.col
    rows = first.select("query_id", "source_id", "of.source_name", "of.programming_language")
    return rows.withColumn(
        "place",
        F.row_number().over(w.Window.partitionBy("query_id").orderBy(name("programming_language"), name("source_name"), name("source_id")))
    )


def fuzzy_gate(queries: DataFrame, bounded: DataFrame) -> DataFrame:
    """Queries with too few exact rows, after the cap by language."""
    counted = bounded.groupBy("query_id").agg(F.count("*").alias("_exact"))
    few = F.coalesce("_exact", F.lit(0)) < F.least("limit", F.lit(LEAST_EXACT))
    return queries.join(counted, "query_id", "left").where(few).drop("_exact")


_OUT = [
    "query_id", "title", "url", "section", "programming_language", "docs_locale", "source_id", "source_name", "source_kind",
    "document_kind", "proposal_status", "score",
]


def in_scope(records: DataFrame, scope: DataFrame, most: int = 1000) -> DataFrame:
    """The records that any query may see. Scopes name catalog entries, so up to ``most`` are written into the filter, which
    reads only their partitions of published records; more are joined."""
    columns = [c for c in SCOPE if c in scope.columns]
    wanted = scope.select(*columns).distinct()
    named = wanted.limit(most + 1).collect()
    if len(named) > most:
        return records.join(wanted, columns, "left_semi")
    out = records.where(F.col(columns[0]).isin(sorted({r[0] for r in named if r[0] is not None})))
    return out if len(columns) == 1 else out.join(F.broadcast(wanted), columns, "left_semi")


def search(
    requests: DataFrame, records: DataFrame | Scanned, limit: int = RUNTIME_LIMIT, collation: str | None = None, fuzzy: bool = True,
    plan: str = "auto", extra: tuple[str, ...] = (), scope: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results with place, facets). ``scope`` (query_id, source_id and optionally docs_locale) says what a query may see: only
    its records are read, and it is a key of the match."""
    return settled_all(requests.sparkSession, lambda: _search(requests, records, limit, collation, fuzzy, plan, extra, scope))


def _search(requests, records, limit, collation, fuzzy, plan, extra, scope) -> tuple[DataFrame, DataFrame]:
    queries, same = tokenized(requests, limit), None
    if isinstance(records, Scanned):
        rows, postings = None, records
    else:
        rows = prepared(records if scope is None else in_scope(records, scope))
        postings = Scanned(rows)
    if scope is not None:
        same = {c: "in_" + c for c in SCOPE if c in scope.columns}
        scope = cut(scope.select("query_id", *(F.col(c).alias(n) for c, n in same.items())).distinct())

    def seen(asked: DataFrame) -> DataFrame:
        return asked if scope is None else asked.join(scope, "query_id")

    def scored(match: Callable[..., DataFrame], asked: DataFrame) -> DataFrame:
        # All that later steps look at are the first of a URL and source with a positive score, which pairs without typos have.
        first = lambda pairs: first_in_order(pairs, "query_id", "url", "source_id")
        pairs = match(seen(asked), rows, plan, same, postings)
        pairs = first(score(pairs)) if "distances" in pairs.columns else score(first(pairs.drop("hay")))
        return cut(pairs.select(*_OUT, *extra, "limit", "catalog_pos", "pos"))

    exact = scored(match_exact, queries)
    kept = cut(bounded_per_language(dedupe_matches(exact), collation))
    out = diversify(kept, collation).select(*_OUT, *extra, "place")
    found = exact
    if fuzzy:
        near = scored(match_fuzzy, cut(fuzzy_gate(queries, kept)))
        fresh = dedupe_matches(near.join(exact.select("query_id", "url"), ["query_id", "url"], "left_anti"))
        taken = out.groupBy("query_id").agg(F.max("place").alias("_taken"))
        rest = bounded_per_language(fresh, collation).join(taken, "query_id", "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
        more = diversify(rest.withColumn("_left", F.col("limit") - F.col("_taken")), collation, "_left")
        out = out.unionByName(more.withColumn("place", F.col("place") + F.col("_taken")).select(*_OUT, *extra, "place"))
        found = exact.unionByName(near)
    return out, facets(found, collation)


def refine(requests: DataFrame, records: DataFrame, sources: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Search again over the chosen sources of each request: (query_id, source_id)."""
    return search(requests, records, scope=sources.select("query_id", "source_id").distinct(), **options)


def suggest(requests: DataFrame, records: DataFrame, fuzzy: bool = True, collation: str | None = None) -> DataFrame:
    """(query_id, title, source_name, place): the first titles that differ in more than case, for texts of three characters."""
    long = requests.where(F.length(F.trim("query")) >= SUGGEST_CHARS).drop("limit")
    found, _ = search(long, records, SUGGEST_LIMIT, collation, fuzzy)
    by_title = w.Window.partitionBy("query_id", F.lower("title")).orderBy("place")
    first = found.withColumn("_n", F.row_number().over(by_title)).where("_n = 1")
    return first.withColumn(
        "place", F.row_number().over(w.Window.partitionBy("query_id").orderBy("place"))
    ).where(F.col("place") <= SUGGESTIONS).select("query_id", "title", "source_name", "place")
