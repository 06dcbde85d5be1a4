"""Operator 1: secret scans over a trigram inverted index. DataFrame functions only.

1. From each rule's regular expression a Boolean trigram query is derived: a choice (OR) of clauses, each a set of trigrams
   (AND) that any match must contain. Letter case is folded, which only widens a query.
2. ``trigram_index`` makes the posting lists: one row for each document and each trigram of the queries that its folded text
   holds. Lists are rows, so one of a trigram in a third of all documents is spread like any other data.
3. ``candidates`` intersects the postings: a document that has all trigrams of a clause is a candidate for the clause's rule.
4. ``scan`` verifies candidates with the expression itself, which also gives the spans. Rules without mandatory trigrams
   (a run of hexadecimal digits) scan every document. The candidates (id and rules, no text) are broadcast while their count
   is within the bound; beyond it only texts that are in the index meet them by a shuffle, and all others stay where they are.

Spans are (kind, start, end) in code points, end exclusive; a kind's matches are leftmost and don't overlap, and a match whose
length or group is too short is dropped after matching, so it still uses up its characters.

Defined results: a null text counts as empty and has no spans. Ids may repeat or be null: a document is known by its id and
a hash of its text, and rows are verified one by one. An empty table gives an empty result; extra columns are kept, whatever
their names. A text's matches are placed by running sums in blocks, so a text of many matches takes time in proportion.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, all_but, columns_free_of, cut, quoted, sized, table


@dataclass(frozen=True)
class Rule:
    """A match counts if it has ``least`` characters, or its ``group`` has."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base rules. Runs are written with their least length where shorter runs can't hide a longer one.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Formats of well-known credentials, which the scan adds.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED

# Trigram queries -------------------------------------------------------------------------------------------------

_GAP = "\0"  # stands for any text
_MOST_CHOICES, _MOST_SET = 64, 8


def _texts(tree) -> list[str]:
    """Strings with gaps; every match contains the pieces between gaps of one of them, in order. A single gap if unknown."""
    parts: list[list[str]] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            parts.append([chr(arg).lower() if arg else _GAP])
        elif op is sre.IN:
            chars = set()
            for kind, x in arg:
                lo, hi = (x, x) if kind is sre.LITERAL else x if kind is sre.RANGE else (0, 1 << 20)
                chars |= {chr(c).lower() for c in range(lo, hi + 1)} if hi - lo < 64 else {_GAP}
            parts.append(sorted(chars) if len(chars) <= _MOST_SET and _GAP not in chars else [_GAP])
        elif op is sre.SUBPATTERN:
            parts.append(_texts(arg[-1]))
        elif op is sre.BRANCH:
            parts.append([t for branch in arg[1] for t in _texts(branch)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            inner = _texts(body)
            if most == 1:
                parts.append(["", *inner] if not least else inner)
            elif least:
                parts.append([f"{t}{_GAP}" for t in inner])
            else:
                parts.append([_GAP])
        elif op is not sre.AT:
            parts.append([_GAP])
    out = [""]
    for choices in parts:
        if len(out) * len(set(choices)) > _MOST_CHOICES:
            choices = [_GAP]
        out = [a + b for a, b in itertools.product(out, dict.fromkeys(choices))]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which a match must hold one, all trigrams of it; none if matches without any trigram may exist."""
    clauses = {
        frozenset(piece[i : i + 3] for piece in text.split(_GAP) for i in range(len(piece) - 2)) for text in _texts(_parser.parse(pattern))
    }
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


# Index -----------------------------------------------------------------------------------------------------------


def query_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, id, h) of the given trigrams over whole folded texts; h is a hash of the text."""
    folded = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text)).alias("h"), F.lower(quoted(text)).alias("folded"))
    present = F.filter(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams)), F.isnotnull)
    return folded.select("id", "h", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, h, kinds): the rules whose trigram query holds in the postings of a document."""
    queries = [(r.kind, n, len(clause), t) for r in rules for n, clause in enumerate(trigram_query(r.pattern)) for t in sorted(clause)]
    wanted = index.sparkSession.createDataFrame(queries, "kind string, clause int, size int, trigram string")  # bounded by the rules
    met = index.join(F.broadcast(wanted), "trigram").groupBy("id", "h", "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("id", "h").agg(F.collect_set("kind").alias("kinds"))


# Verification ----------------------------------------------------------------------------------------------------

_SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"


#: Numbers that one running sum goes over; longer lists are summed by blocks, and these by blocks again.
BLOCK = 128


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column, levels: int = 2) -> Column:
    """For each number of an int array, the sum of those before it."""
    if not levels:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(
            numbers, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")),
            lambda a: a["before"]
        )
    size = BLOCK**levels
    offsets = lambda blocks: running_sums(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)), 0)
    placed = lambda blocks: F.zip_with(
        blocks, offsets(blocks), lambda x, base: F.transform(running_sums(x, levels - 1), lambda y: y + base)
    )
    cut_up = lambda every: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(every) - 1, F.lit(0)), F.lit(size)), lambda at: F.slice(every, at + 1, size)
    )
    return F.flatten(bound(bound(numbers, cut_up), placed))


def matches_of(text: Column, rule: Rule) -> Column:
    """Each match's size, the length of the text between it and the one before, and whether it counts."""
    none = F.array().cast("array<struct<gap:int,size:int,counts:boolean>>")
    found = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("size"),
            (F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least).alias("counts")
        ),
    )
    return F.when(F.rlike(text, F.lit(rule.pattern)), F.filter(found, lambda x: x["size"].isNotNull())).otherwise(none)


def spans_of(matches: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of the counted matches of each rule, in order of place in the text. ``matches`` has those of each rule."""

    def of_rule(own: Column, place: Column) -> Column:
        kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), place + 1)
        before = running_sums(F.transform(own, lambda x: x["gap"] + x["size"]))
        with_place = F.zip_with(
            own, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), x["size"].alias("size"), x["counts"].alias("counts"))
        )
        return F.transform(
            F.filter(with_place, lambda x: x["counts"]),
            lambda x: F.struct(x["start"], place.alias("place"), kind.alias("kind"), (x["start"] + x["size"]).alias("end"))
        )

    return F.array_sort(F.flatten(F.transform(matches, of_rule)))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text", most: int = BROADCAST_ROWS
) -> DataFrame:
    """``docs`` and column ``secrets``: array of (start, place, kind, end), in order; place is the rule's number."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    own = columns_free_of(docs, "candidate")
    docs = docs.select(*map(quoted, all_but(docs, "secrets")))
    none = F.array().cast("array<string>")
    if not indexed:
        docs = docs.withColumn(f"{own}_kinds", none)
    else:
        trigrams = query_trigrams(rules)
        found = cut(candidates(trigram_index(docs, trigrams, id_col, text), tuple(indexed)))
        n_found = found.count()
        found = sized(
            found.select(F.col("id").alias(f"{own}_id"), F.col("h").alias(f"{own}_h"), F.col("kinds").alias(f"{own}_kinds")), n_found, most
        )
        same = quoted(id_col).eqNullSafe(F.col(f"{own}_id")) & (F.xxhash64(quoted(text)) == F.col(f"{own}_h"))
        meet = lambda rows: rows.join(found, same, "left").drop(f"{own}_id", f"{own}_h")
        if n_found <= most:
            docs = meet(docs)
        else:
            known = F.coalesce(F.exists(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.lower(quoted(text)), t)), F.lit(False))
            docs = meet(docs.where(known)).unionByName(docs.where(~known).withColumn(f"{own}_kinds", none))
    body = F.coalesce(quoted(text), F.lit(""))
    matches = [
        matches_of(body, r) if r not in indexed else F.when(F.array_contains(f"{own}_kinds", r.kind), matches_of(body, r)) for r in rules
    ]
    each = F.array(*(F.coalesce(m, F.array().cast("array<struct<gap:int,size:int,counts:boolean>>")) for m in matches))
    # The matches are a column of their own, as texts without any need no placing.
    docs = docs.withColumn(f"{own}_matches", each)
    some = F.exists(f"{own}_matches", lambda m: F.size(m) > 0)
    return docs.withColumn(
        "secrets", F.when(some, spans_of(F.col(f"{own}_matches"), rules)).otherwise(F.array().cast(_SPAN))
    ).drop(f"{own}_kinds", f"{own}_matches")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_is(kind: str):
    return lambda span: span["kind"] == kind


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    counted = [F.size(F.filter("secrets", kind_is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("secrets", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *counted, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _sql() -> str:
    """Plain matching of every text, without an index."""

    def plain(pattern: str) -> str:  # letters in either case, ASCII only
        out = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)
        return out.replace("'", "''")

    each = []
    for place, r in enumerate(RULES):
        p = plain(r.pattern)
        each.append(f"""
  SELECT doc_id, {place} AS place, '{r.kind}' AS kind, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i-1], '')) AS start, length(hits[i]) AS size
  FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM docs WHERE regexp_matches(t, '{p}')))
  WHERE length(regexp_extract(hits[i], '{p}', {r.group})) >= {r.least}""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(each)}
), joined AS (
  SELECT doc_id, count_if(place = 0) AS n_assign, count_if(place = 1) AS n_access, count_if(place = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place) AS spans
  FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)
"""


SQL = _sql()
