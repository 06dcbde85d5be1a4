"""Operator 5: quality rules. DataFrame functions only.

Each text's counts give base rules (too short, too repetitive) and a vector of transformed statistics. Three levels of groups,
all rows, each language, each language and source, get minimum-covariance-determinant estimates from their vectors that pass
the base rules. From several starts (medians and quartiles, covariances of bounded transforms, spatial signs) concentration
steps keep the share ``KEEP`` of rows of least Mahalanobis distance and re-estimate mean and covariance from them. After a few
the start of least determinant goes on, until that falls no more, and a last step re-weights by a chi-square cut. A group of n rows takes its
language's estimate with the weight of ``PRIOR`` rows, and a language that of all rows, so every row has an estimate and
small groups lean on the larger ones without a switch. A row whose distance exceeds the chi-square quantile at
``1 - ALPHA`` is rejected. Groups reduce to quantile sketches and partial sums, so no step gathers or sorts a group in one
task; only one row of estimates for each group is joined back.

``SPREAD`` is the least deviation of each statistic that matters, added to the variances: statistics that are 0 in nearly all
texts of a group would have none. Lines and windows of words count as equal by the text and by a 64-bit hash.

Defined results: a null or wordless text has only zeros and fails the base rules. Null languages and sources are groups of
their own. Rows are counted one by one, repeated ones too. Without any row that passes the base rules there is no estimate
and no other rule; an empty table gives an empty result. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from .common import BROADCAST_ROWS, WORD, all_but, cut, look_up, quoted, settled, sized, table

LEAST_WORDS, MOST_REPEATED, SHINGLE = 50, 0.5, 3
KEEP, PRIOR, ALPHA = 0.75, 50, 1e-9

#: Steps that all starts take. A group's best one then goes on until its log determinant changes by less than this, or after so
#: many steps, with a warning.
FIRST_STEPS, FALL, MOST_STEPS = 3, 1e-3, 30

#: Relative accuracy of quantiles: one in so many rows; exact for smaller groups.
ACCURACY = 5000
SYMBOLS = r"[#*$%&|<>]"

#: The statistics and their least spread.
SPREAD = {"x_length": 0.5, "x_word": 0.08, "x_symbols": 0.5, "x_lines": 0.15, "x_repeats": 0.15}
_X = list(SPREAD)


# Counts ----------------------------------------------------------------------------------------------------------


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words for ``text``."""
    body = F.coalesce(quoted(text), F.lit(""))
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = all_but(docs, text, *own)
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *map(quoted, keep)).alias("_doc"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(WORD))).alias("_lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    windows = F.zip_with(
        F.zip_with(F.slice("_words", 1, n - 2), F.slice("_words", 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("_words", 3, n - 2),
        lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
    )
    rows = rows.withColumn("_windows", F.when(n >= SHINGLE, windows).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(
        "_doc", "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Windows are sorted by hash only where some repeat.
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("_sorted"),
    )
    pairs = F.zip_with(
        F.slice("_sorted", 1, F.size("_sorted") - 1), F.slice("_sorted", 2, F.size("_sorted") - 1), lambda a,
        b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    )
    rows = rows.withColumn("_places", F.array_sort(F.array_distinct(F.flatten(pairs))))
    covered = F.zip_with(
        "_places", F.slice("_places", 2, F.size("_places")), lambda p, q: F.least(F.lit(SHINGLE), F.coalesce(q - p, F.lit(SHINGLE)))
    )
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.withColumn("n_repeat_words", repeated).select(*(F.col("_doc").getField(c).alias(c) for c in keep), *own)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """Transformed so that ordinary texts are about normal."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x_length": F.log(words.cast("double")),
        "x_word": F.log(chars / words),
        "x_symbols": F.log1p(1000 * F.col("n_symbols") / chars),
        "x_lines": F.asin(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        "x_repeats": F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    }


# Estimates -------------------------------------------------------------------------------------------------------


def chi_square(x: float, k: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 2.0
    while chi_square(hi, k) < p:
        hi *= 2
    for _ in range(100):
        lo, hi = (lo, (lo + hi) / 2) if chi_square((lo + hi) / 2, k) >= p else ((lo + hi) / 2, hi)
    return hi


_D = range(len(_X))
_LOWER = [(i, j) for i in _D for j in range(i + 1)]
_ESTIMATE = ["n", *(f"m_{i}" for i in _D), *(f"c_{i}_{j}" for i, j in _LOWER)]


def _sums(x: list[Column], when: Column | None = None) -> list[Column]:
    """Number, sums and sums of products of vectors."""
    held = (lambda v: v) if when is None else (lambda v: F.when(when, v))
    return [
        F.count(held(F.lit(1))).alias("n"), *(F.sum(held(x[i])).alias(f"s_{i}") for i in _D),
        *(F.sum(held(x[i] * x[j])).alias(f"s_{i}_{j}") for i, j in _LOWER)
    ]


def _moments(sums: DataFrame, *keep: str) -> DataFrame:
    """Means m_i and covariances c_i_j from sums."""
    mean = lambda i: F.col(f"s_{i}") / F.col("n")
    cov = lambda i, j: F.greatest(
        F.col(f"s_{i}_{j}") / F.col("n") - mean(i) * mean(j), F.lit(0.0) if i == j else F.lit(-1e300)
    )
    return sums.select(*keep, "n", *(mean(i).alias(f"m_{i}") for i in _D), *(cov(i, j).alias(f"c_{i}_{j}") for i, j in _LOWER))


def _whitened(estimates: DataFrame, factor: float, *keep: str) -> DataFrame:
    """From means and covariances: means m_i, the inverse Cholesky factor w_i_j of the covariance, times ``factor`` and with
    the least spread, and the log determinant."""
    out = estimates
    for i, j in _LOWER:
        cov = factor * F.col(f"c_{i}_{j}") + (SPREAD[_X[i]] ** 2 if i == j else 0)
        for k in range(j):
            cov = cov - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(cov, F.lit(1e-12))) if i == j else cov / F.col(f"l_{j}_{j}"))
    for i, j in _LOWER:
        entry = F.lit(1.0) if i == j else sum((-F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0))
        out = out.withColumn(f"w_{i}_{j}", entry / F.col(f"l_{i}_{i}"))
    volume = sum((2 * F.log(f"l_{i}_{i}") for i in _D), F.lit(0.0))
    return out.select(*keep, *(f"m_{i}" for i in _D), *(f"w_{i}_{j}" for i, j in _LOWER), volume.alias("volume"))


def _distance() -> Column:
    lengths = (sum((F.col(f"w_{i}_{j}") * (F.col(_X[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in _D)
    return sum((y * y for y in lengths), F.lit(0.0))


def _starts(rows: DataFrame, n_groups: int) -> DataFrame:
    """(g, start, means and covariances) from medians and quartiles: a diagonal, and two kinds of bounded covariances."""
    quartiles = rows.groupBy("g").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(f"q_{i}") for i, x in enumerate(_X)))
    scale = lambda i: F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(SPREAD[_X[i]]))
    middle = quartiles.select("g", *(F.col(f"q_{i}")[1].alias(f"mid_{i}") for i in _D), *(scale(i).alias(f"scale_{i}") for i in _D))
    middle = cut(middle, n_groups)
    z = look_up(rows, middle, "g", n_groups).withColumns(
        {f"z_{i}": (F.col(x) - F.col(f"mid_{i}")) / F.col(f"scale_{i}") for i, x in enumerate(_X)}
    )
    length = F.sqrt(sum((F.col(f"z_{i}") ** 2 for i in _D), F.lit(1e-12)))
    squashed = [F.tanh(f"z_{i}") for i in _D]
    signs = [F.col(f"z_{i}") / length for i in _D]
    product = lambda x, name: [F.avg(x[i] * x[j]).alias(f"{name}_{i}_{j}") for i, j in _LOWER]
    found = cut(z.groupBy("g").agg(*product(squashed, "a"), *product(signs, "b")).join(middle, "g"), n_groups)
    like = lambda name, i, j: F.col(f"{name}_{i}_{j}") / F.sqrt(
        F.greatest(F.col(f"{name}_{i}_{i}") * F.col(f"{name}_{j}_{j}"), F.lit(1e-12))
    )
    start = lambda k, cor: found.select(
        "g", F.lit(k).alias("start"), *(F.col(f"mid_{i}").alias(f"m_{i}") for i in _D),
        *((cor(i, j) * F.col(f"scale_{i}") * F.col(f"scale_{j}")).alias(f"c_{i}_{j}") for i, j in _LOWER)
    )
    return start(0, lambda i, j: F.lit(float(i == j))).unionByName(start(1, lambda i, j: like("a", i, j))).unionByName(start(2, lambda i, j: like("b", i, j)))


def concentrated(rows: DataFrame, n_groups: int, keep: float = KEEP) -> DataFrame:
    """From (g, x...): the whitening estimate of least volume for each g. ``rows`` must be read from files."""
    d = len(_X)
    key = F.struct("g", "start").alias("of")
    estimate = cut(_whitened(_starts(rows, n_groups), 1.0, "g", "start").select(key, "*").drop("g", "start"), 3 * n_groups)
    n_starts = 3 * n_groups
    # The covariance of the nearest share of a normal sample is too small by this.
    shrunk = keep / chi_square(chi_square_quantile(keep, d), d + 2)
    each = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(3))))).withColumn("of", key).select("of", *_X)

    def step(each: DataFrame, estimate: DataFrame, n: int) -> DataFrame:
        apart = look_up(each, estimate, "of", n).withColumn("distance", _distance())
        edges = apart.groupBy("of").agg(F.percentile_approx("distance", keep, ACCURACY).alias("edge"))
        nearest = look_up(apart, edges, "of", n).where("distance <= edge")
        return cut(_whitened(_moments(nearest.groupBy("of").agg(*_sums([F.col(x) for x in _X])), "of"), shrunk, "of"), n)

    for _ in range(FIRST_STEPS):
        estimate = step(each, estimate, n_starts)
    # Of each group the start that is best by now goes on, as long as its volume falls.
    best = F.min_by(F.struct(*(c for c in estimate.columns if c != "of")), F.struct("volume", "of.start"))
    estimate = cut(estimate.groupBy(F.col("of.g").alias("of")).agg(best.alias("best")).select("of", "best.*"), n_groups)
    rows, done = rows.withColumnRenamed("g", "of"), []
    for _ in range(MOST_STEPS - FIRST_STEPS):
        n = estimate.count()
        if not n:
            break
        going = rows if not done else rows.join(sized(estimate.select("of"), n), "of", "left_semi")
        new = step(going, estimate, n)
        moved = cut(new.join(estimate.select("of", F.col("volume").alias("before")), "of"), n)
        more = F.abs(F.col("before") - F.col("volume")) >= FALL
        done.append(moved.where(~more).drop("before"))
        estimate = cut(moved.where(more).drop("before"), n)
    else:
        if left := estimate.count():
            warnings.warn(f"{left} groups have not converged after {MOST_STEPS} steps; their last estimates count", stacklevel=2)
            done.append(estimate)
    return cut(reduce(DataFrame.unionByName, done or [estimate]).withColumnRenamed("of", "g"), n_groups)


def robust_estimates(rows: DataFrame, n_groups: int, keep: float = KEEP) -> DataFrame:
    """From (g, x...): one row of n, means and covariances for each g. ``rows`` must be read from files."""
    d, cutoff = len(_X), 0.975
    best = concentrated(rows, n_groups, keep)
    inside = look_up(rows, best, "g", n_groups).withColumn("near", _distance() <= chi_square_quantile(cutoff, d))
    sums = inside.groupBy("g").agg(F.count("*").alias("rows"), *_sums([F.col(x) for x in _X], F.col("near")))
    factor = cutoff / chi_square(chi_square_quantile(cutoff, d), d + 2)
    moments = _moments(sums, "g", "rows").withColumns({f"c_{i}_{j}": factor * F.col(f"c_{i}_{j}") for i, j in _LOWER})
    return cut(moments.drop("n").withColumnRenamed("rows", "n").select("g", *_ESTIMATE), n_groups)


def leaning(own: DataFrame, prior: DataFrame, prior_key: Column, n_prior: int, n_own: int, weight: float = PRIOR) -> DataFrame:
    """``own`` estimates, each with that of ``prior`` as of ``weight`` more rows."""
    renamed = prior.select(F.col("g").alias("above"), *(F.col(c).alias("above_" + c) for c in _ESTIMATE[1:]))
    both = look_up(cut(own.withColumn("above", prior_key), n_own), renamed, "above", n_prior)
    mixed = lambda c: ((F.col("n") * F.col(c) + weight * F.col("above_" + c)) / (F.col("n") + weight)).alias(c)
    return cut(both.select("g", "n", *map(mixed, _ESTIMATE[1:])), n_own)


def _estimates_of_sources(leveled: DataFrame, n_groups: int, level, whole: Column, no_source: Column) -> DataFrame:
    """The whitened estimate of each language and source."""
    estimates = robust_estimates(leveled, n_groups)
    at = lambda k: estimates.where(F.col("g.level") == k)
    above = level(1, F.col("g.lang").alias("lang"), no_source)
    langs = leaning(at(1), at(0), whole, 1, n_groups)
    sources = leaning(at(2), langs, above, n_groups, n_groups)
    # Of groups without a row that passes the base rules no row can be kept, so they need no estimate.
    return _whitened(sources.withColumn("g", F.struct("g.lang", "g.source")), 1.0, "g")


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``docs`` without ``text``, with the counts, base_failed, distance (null where there is no estimate) and kept."""
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
    keep = all_but(docs, text, *own)
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *map(quoted, keep)).alias("doc"),
        F.struct(quoted(lang).alias("lang"), quoted(source).alias("source")).alias("g"), quoted(text).alias("text")
    )
    rows = cut(counts(packed).withColumn("base_failed", base_failed()).withColumns(statistics()))
    passed = rows.where(~F.col("base_failed")).select("g", *_X)
    # Groups of the three levels have keys of one shape.
    level = lambda k, *parts: F.struct(F.lit(k).alias("level"), *parts)
    no_lang, no_source = F.lit(None).cast(rows.schema["g"].dataType["lang"].dataType).alias("lang"), F.lit(None).cast(
        rows.schema["g"].dataType["source"].dataType
    ).alias("source")
    whole, of_lang, of_source = level(0, no_lang, no_source), level(1, F.col("g.lang").alias("lang"), no_source), level(
        2, F.col("g.lang").alias("lang"), F.col("g.source").alias("source")
    )

    def estimated() -> DataFrame:
        leveled = passed.select(F.explode(F.array(whole, of_lang, of_source)).alias("g"), *_X)
        n_groups = leveled.select("g").distinct().count()
        return _estimates_of_sources(leveled, n_groups, level, whole, no_source)

    final = settled(docs.sparkSession, estimated)
    n_groups = final.count()
    judged = look_up(rows, final, "g", n_groups).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    far = F.coalesce(F.col("distance") > chi_square_quantile(1 - alpha, len(_X)), F.lit(False))
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~far)
    return judged.select(*(F.col("doc").getField(c).alias(c) for c in keep), *own)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
