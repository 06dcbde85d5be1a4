"""Search query strings: words, language prefixes and flags, parsed with array functions. Offsets are in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_language_id

# What flags accept, and the error codes.
LOCALES, SOURCE_MODES = ("en", "ja"), ("official", "all")
FLAGS = {"lang:": "language", "locale:": "locale", "source:": "source"}

_TOKEN = "array<struct<value:string,start:int,end:int>>"
_FLAG = "array<struct<start:int,end:int,kind:string,token:string,valid:boolean>>"
_ERROR = "array<struct<code:string,token:string>>"


def tokens(raw: Column) -> Column:
    """Runs without white space, with their places."""
    parts = F.zip_with(
        F.split(raw, r"(?U)\S+", -1), F.regexp_extract_all(raw, F.lit(r"(?U)\S+"), F.lit(0)), lambda gap,
        word: F.struct(gap.alias("gap"), word.alias("word"))
    )

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["word"]), F.lit(0))
        token = F.struct(x["word"].alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(
            end.cast("int").alias("at"),
            F.when(x["word"].isNotNull(), F.concat(seen["out"], F.array(token))).otherwise(seen["out"]).alias("out")
        )

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(_TOKEN).alias("out")), step, lambda seen: seen["out"])


def _run(array: Column, holds) -> Column:
    """How many elements from the start on hold."""
    first = F.array_position(F.transform(array, lambda x: ~holds(x)), True)
    return F.when(first == 0, F.size(array)).otherwise(first - 1).cast("int")


def _kind(token: Column, fold: bool = True) -> Column:
    value = F.lower(token["value"]) if fold else token["value"]
    out = None
    for prefix, kind in FLAGS.items():
        out = (F if out is None else out).when(F.startswith(value, F.lit(prefix)), F.lit(kind))
    return out


def _value(token: Column) -> Column:
    return F.lower(F.regexp_replace(token["value"], "^[^:]*:", ""))


def _is_flag(token: Column) -> Column:
    return F.coalesce(_kind(token).isNotNull(), F.lit(False))


def _fault(token: Column) -> Column:
    kind, value = _kind(token), _value(token)
    return F.when((kind == "locale") & ~value.isin(*LOCALES), F.lit("invalid_locale")).when(
        (kind == "source") & ~value.isin(*SOURCE_MODES), F.lit("invalid_source_mode")
    )


def parse_query(df: DataFrame, raw: str = "raw", known: str = "known_languages") -> DataFrame:
    """``df`` with search_text, languages, locale, source_mode, flags and errors.

    A leading list of known languages, then flags at either end, set the scope; of flags of a kind, the last before the words
    is overridden by the first after them. Flags among the words stay words and are reported. A query without any word has
    no error if it is blank altogether."""
    n = F.size("_tokens")
    out = df.withColumn("_tokens", tokens(F.coalesce(F.col(raw), F.lit(""))))
    k = F.least(_run(F.col("_tokens"), lambda t: F.endswith(t["value"], F.lit(","))) + 1, n)
    out = out.withColumn("_k", k).withColumn(
        "_bare", F.array_join(F.transform(F.slice("_tokens", 1, F.col("_k")), lambda t: t["value"]), "")
    )
    names = F.transform(F.split("_bare", ",", -1), normalize_language_id)
    is_bare = (n > 0) & ~F.contains("_bare", F.lit(":")) & F.forall("_names", lambda x: (x != "") & F.array_contains(F.col(known), x))
    out = out.withColumn("_names", names).withColumn("_is_bare", F.coalesce(is_bare, F.lit(False)))
    out = out.withColumn("_rest", F.slice("_tokens", F.when(F.col("_is_bare"), F.col("_k")).otherwise(0) + 1, F.greatest(n, F.lit(1))))
    out = out.withColumn("_lead", _run(F.col("_rest"), _is_flag)).withColumn(
        "_rest2", F.slice("_rest", F.col("_lead") + 1, F.greatest(n, F.lit(1)))
    )
    out = out.withColumn("_trail", _run(F.reverse("_rest2"), _is_flag))
    middle = F.slice("_rest2", F.lit(1), F.size("_rest2") - F.col("_trail"))
    applied = F.concat(F.slice("_rest", F.lit(1), F.col("_lead")), F.slice(F.reverse("_rest2"), F.lit(1), F.col("_trail")))
    out = out.withColumn("_middle", middle).withColumn("_applied", applied)

    def last(kind: str, valid: bool) -> Column:
        return F.try_element_at(F.filter("_applied", lambda t: (_kind(t) == kind) & (F.lit(not valid) | _fault(t).isNull())), F.lit(-1))

    bare_flag = F.struct(F.get("_tokens", F.lit(0))["start"].alias("start"), F.get("_tokens", F.col("_k") - 1)["end"].alias("end"))
    token_text = F.substring(F.col(raw), bare_flag["start"] + 1, bare_flag["end"] - bare_flag["start"])
    bare = F.when(
        F.col("_is_bare"),
        F.array(
            F.struct(
                bare_flag["start"].alias("start"), bare_flag["end"].alias("end"), F.lit("language").alias("kind"),
                token_text.alias("token"), F.lit(True).alias("valid")
            )
        )
    ).otherwise(F.array().cast(_FLAG))
    ends = F.transform(
        "_applied",
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), _kind(t).alias("kind"), t["value"].alias("token"),
            _fault(t).isNull().alias("valid")
        )
    )
    astray = F.transform(
        F.filter("_middle", _is_flag),
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), F.coalesce(_kind(t, fold=False), F.lit("source")).alias("kind"),
            t["value"].alias("token"), F.lit(False).alias("valid")
        )
    )
    faults = F.transform(
        F.filter("_applied", lambda t: _fault(t).isNotNull()), lambda t: F.struct(_fault(t).alias("code"), t["value"].alias("token"))
    )
    misplaced = F.transform(
        F.filter("_middle", _is_flag), lambda t: F.struct(F.lit("flag_in_search_text").alias("code"), t["value"].alias("token"))
    )
    empty = F.when(
        (n > 0) & (F.size("_middle") == 0),
        F.array(F.struct(F.lit("empty_search_text").alias("code"), F.lit(None).cast("string").alias("token")))
    ).otherwise(F.array().cast(_ERROR))
    flagged = last("language", False)
    languages = F.when(
        flagged.isNotNull(), F.filter(F.transform(F.split(_value(flagged), ","), normalize_language_id), lambda x: x != "")
    ).when(F.col("_is_bare"), F.col("_names")).otherwise(F.array().cast("array<string>"))
    return out.select(
        *df.columns,
        F.array_join(F.transform("_middle", lambda t: t["value"]), " ").alias("search_text"),
        F.array_distinct(languages).alias("languages"),
        _value(last("locale", True)).alias("locale"),
        _value(last("source", True)).alias("source_mode"),
        F.array_sort(F.concat(bare, ends, astray)).alias("flags"),
        F.concat(faults, misplaced, empty).alias("errors"),
    )
