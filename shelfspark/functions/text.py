"""Text functions. All are column expressions but for Unicode normalisation and numeric entities, which Spark lacks."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Alternative names of language ids.
LANGUAGE_IDS = {
    "c++": "cpp", "cplusplus": "cpp",
    "c#": "csharp", "cs": "csharp",
    "js": "javascript", "ecmascript": "javascript",
    "ts": "typescript",
    "py": "python",
    "rs": "rust",
    "rb": "ruby",
    "golang": "go",
}

# XML entities.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " "}

# States of a proposal.
NOT_CURRENT = "(?i)withdrawn|rejected|superseded|inactive|deferred"
DRAFT_LIKE = r"(?i)draft|candidate|submitted|stage-[01](?:\D|$)"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@cache
def nfkc_changes() -> str:
    """A pattern of the characters that NFKC may change, alone or after others: those that have another form, that combine, or
    that are the second part of a composed one. Texts without any are normal. Built from the character data that ``nfkc`` uses."""
    marked = bytearray(0x110001)
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c:
            marked[code] = 1
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            marked[int(parts[1], 16)] = 1
    marked[0x1161:0x1176] = b"\1" * 21  # vowels and final consonants that Hangul syllables are composed of
    marked[0x11A8:0x11C3] = b"\1" * 27
    edges = [i for i in range(len(marked)) if marked[i] != marked[i - 1]]
    return f"[{_halved([(a, b - 1) for a, b in zip(edges[::2], edges[1::2])])}]"


def _halved(ranges: list[tuple[int, int]]) -> str:
    """The inside of a character class of sorted ranges. Each half stands behind its outer bounds, so that a character is held
    against some ranges of thousands, and an ASCII one against one."""
    if len(ranges) <= 4:
        return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    middle = len(ranges) // 2
    return "".join(f"[\\x{{{part[0][0]:X}}}-\\x{{{part[-1][1]:X}}}&&[{_halved(part)}]]" for part in (ranges[:middle], ranges[middle:]))


def normalize_text(c: Column) -> Column:
    """NFKC, lower case, runs of ``_`` and ``-`` and of white space to one space, trimmed. Texts that NFKC leaves alone, which
    are those without a character of ``nfkc_changes``, are done without the helper."""
    changes = (F.length(c) != F.octet_length(c)) & F.rlike(c, F.lit(nfkc_changes()))
    c = F.when(changes, nfkc(F.when(changes, c))).otherwise(c)
    return collapse(F.replace(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))


def collapse(c: Column) -> Column:
    """White space (any Unicode space) to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{FEFF}&&[^ ]][\s\x{FEFF}]*| [\s\x{FEFF}]+", " "))  # single spaces stay


def words_of(c: Column) -> Column:
    """Distinct runs of letters and digits, in order."""
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def tokens_of(c: Column) -> Column:
    """Distinct tokens of a normalised query."""
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))


def normalize_language_id(c: Column) -> Column:
    name = F.lower(F.trim(c))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_IDS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), name)


def proposal_status_class(c: Column) -> Column:
    return F.when(
        F.rlike(c, F.lit(NOT_CURRENT)), "not-current"
    ).when(F.rlike(c, F.lit(DRAFT_LIKE)), "draft").when(c.isNotNull() & (c != ""), "current")


def decode_entities(c: Column, numeric: bool = False, cdata: bool = False) -> Column:
    """XML entities; ``&amp;`` last, so that nothing is decoded twice."""
    if cdata:
        c = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    if numeric:
        c = F.when(F.contains(c, F.lit("&#")), _numeric(c)).otherwise(c)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(StringType())
def _numeric(texts: pd.Series) -> pd.Series:
    def char(m) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return texts.str.replace(r"&#(?:[xX]([0-9A-Fa-f]{1,8})|([0-9]{1,9}));", char, regex=True)


def plain_markdown(c: Column) -> Column:
    """Text of inline Markdown: images go, links and code keep their text, tags, emphasis and escapes go."""
    for pattern, by in (
        (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", "$1"), (r"</?[A-Za-z][^>]*>", ""), (r"`([^`]*)`", "$1"),
        (r"(\*\*|__)(.*?)\1", "$2"), (r"(^|[^\w*\\])\*(?!\s)([^*\\]*[^\s*\\])\*", "$1$2"), (r"\\([\\`*_{}\[\]()#+.!|<>-])", "$1")
    ):
        c = F.regexp_replace(c, pattern, by)
    return collapse(c)


def markdown_cell_text(c: Column) -> Column:
    """Text of a cell of a Markdown table."""
    return plain_markdown(F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", " "), r"\\\|", "|"))
