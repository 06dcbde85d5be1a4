"""Operator 2: toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < ... < K-1 follow P(grade > k) = logistic(w . x - t_k) with one weight vector w for all thresholds
t_0 < t_1 < ... . Features x are sparse and grow with the logarithm of their counts in the whole text: each word, its
leading and trailing letters. The fit is L1-penalised (accelerated proximal gradient), so a few telling features keep weights
and long clean texts gather no noise. The output is the expected severity, the sum over k of P(grade > k).

The fit reads a sample of labelled rows bounded by ``SAMPLE`` (documented parameter; the rows of smallest hashed id, whole
texts). All features of the sample take part, scaled by their rarity; they stay on the executors, and the driver holds a
working set: the features of greatest slope enter, the fit runs, and an aggregate over all features then gives every slope at
the fit. Features whose slope exceeds the penalty enter in turn, until none does by more than a ``SLACK`` share of it: up to
that, all others have weight 0 at the optimum over all features. Every document is scored over its whole text, on the executors, with a memo of bounded size.

Grades of op2, from the two labels: 0 not toxic, 1 toxic, 2 toxic and of low quality.

Defined results: a null, empty or wordless text has no features, so its severity is that of the thresholds alone. Repeated
labels of a document must agree, else the highest grade counts; labels or ids that are null are left out, and of rows that
share an id one is learned from, that of the least text hash. Without any labelled row, or with one grade only, all severities
are 0; if no feature tells, they are that of the thresholds, the grades' shares; an empty table gives an empty result. Extra columns are kept, whatever their names; rows are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w
from pyspark.sql.types import ArrayType, DoubleType

from .common import all_but, cut, discarded, hash_sample, map_batches, parts_of, quoted, sized, table

SAMPLE, STEPS, PENALTY = 6000, 300, 1e-3

#: Features that enter the working set in one round, and the part of the penalty by which a slope may exceed it at the end.
ROUND, SLACK = 500, 0.05

#: Expected severity from which a document is rejected.
REJECT = 0.4

MEMO = 200_000
_WORDS = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[str]:
    """The word and, of longer ones, leading and trailing letters."""
    out = [word]
    out += [f"{word[:n]}+" for n in (3, 4, 5) if len(word) > n]
    out += [f"+{word[-n:]}" for n in (3, 4) if len(word) > n]
    return out


def _counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(_WORDS((text or "").lower())).items():
        for f in features_of(word):
            found[f] += n
    return found


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade) from columns toxic and quality."""
    grade = F.when(F.col("toxic") == 0, F.lit(0)).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, F.lit(2)).otherwise(F.lit(1)))
    known = labels.select(quoted(id_col), grade.cast("int").alias("grade")).where(F.col("grade").isNotNull() & quoted(id_col).isNotNull())
    return known.groupBy(quoted(id_col)).agg(F.max("grade").alias("grade"))


class Model:
    """weights by feature, thresholds in rising order."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def slopes(score: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log likelihood: its derivative by each row's score, and by each threshold."""
    n, top = len(grade), len(cuts)
    edge = np.c_[np.ones(n), _logistic(score[:, None] - cuts), np.zeros(n)]  # P(grade > k), for k from -1
    i = np.arange(n)
    hi, lo = edge[i, grade], edge[i, grade + 1]
    mass = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
    by_cut = np.zeros(top + 2)
    np.add.at(by_cut, grade, -d_hi / n)
    np.add.at(by_cut, grade + 1, d_lo / n)
    return (d_hi - d_lo) / n, by_cut[1 : top + 1]


def first_cuts(grade: np.ndarray) -> np.ndarray:
    """Thresholds that give the grades' shares without any feature."""
    above = np.array([(grade > k).mean() for k in range(int(grade.max()))]).clip(1e-3, 1 - 1e-3)
    return np.maximum.accumulate(np.log((1 - above) / above) + 1e-3 * np.arange(len(above)))


def fit(
    rows, cols, values: np.ndarray, grade: np.ndarray, n_features: int, steps: int = STEPS, penalty: float = PENALTY,
    start: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalised likelihood. Thresholds are a first one and positive gaps (as exponents)."""
    n = len(grade)
    rows, cols, values = np.asarray(rows), np.asarray(cols), np.asarray(values)
    w, cuts = start or (np.zeros(n_features), first_cuts(grade))
    w, z, t = w.copy(), w.copy(), 1.0
    theta = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))]
    theta_z = theta.copy()
    # The likelihood's curvature in w is at most that of the squared feature rows; a power iteration bounds it.
    v = np.ones(n_features) / max(1, n_features) ** 0.5
    norm = 1.0
    for _ in range(15):
        v = np.bincount(cols, values * np.bincount(rows, values * v[cols], n)[rows], n_features)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate, rate_t = 2.0 / (norm / n + 1e-9), 0.3
    for _ in range(steps):
        by_score, by_cut = slopes(np.bincount(rows, values * z[cols], n), np.cumsum(np.r_[theta_z[0], np.exp(theta_z[1:])]), grade)
        tail = np.cumsum(by_cut[::-1])[::-1]
        new = z + rate * np.bincount(cols, values * by_score[rows], n_features)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        theta_new = theta_z + rate_t * np.r_[tail[0], tail[1:] * np.exp(theta_z[1:])]
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, theta_z = new + (before - 1) / t * (new - w), theta_new
        w, theta = new, theta_new
    return w, np.cumsum(np.r_[theta[0], np.exp(theta[1:])])


def sampled(docs: DataFrame, graded: DataFrame, id_col: str, text: str, sample: int) -> DataFrame:
    """(row, grade, f, feature, n): the features of the sampled rows, f a hash of each, ``row`` from 0 on; one row without
    feature for each."""
    ids = hash_sample(graded, quoted(id_col), graded.count(), sample)
    picked = ids.orderBy(  # the documented bound
        F.xxhash64(quoted(id_col)), quoted(id_col)
    ).limit(sample).select(quoted(id_col).alias("id"), "grade")
    rows = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text")).join(F.broadcast(picked), "id")
    rows = cut(rows.groupBy("id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    number = F.row_number().over(w.Window.orderBy(F.xxhash64("id"), "id")) - 1  # of the bounded sample
    rows = rows.drop("grade").join(F.broadcast(rows.select("id", "grade", number.alias("row"))), "id").select("row", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts_of(batch, 2)):
            found = [_counts(body) for body in part.column(2).to_pylist()]
            sizes = [len(x) + 1 for x in found]
            of = lambda at: np.repeat(part.column(at).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of(0)), pa.array(of(1)), pa.array([f for x in found for f in ("", *x)]),
                    pa.array([n for x in found for n in (0, *x.values())], pa.int32())
                ],
                ["row", "grade", "feature", "n"]
            )

    found = rows.mapInArrow(run, "row int, grade int, feature string, n int")
    return cut(found.select("row", "grade", F.xxhash64("feature").alias("f"), "feature", "n"))


def train(
    docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE, together: int = ROUND,
    penalty: float = PENALTY
) -> Model:
    """The model of the labelled rows (id, grade); what the fit writes on the way is deleted."""
    with discarded(docs.sparkSession):
        return _trained(docs, graded, id_col, text, sample, together, penalty)


def _trained(docs: DataFrame, graded: DataFrame, id_col: str, text: str, sample: int, together: int, penalty: float) -> Model:
    spark = docs.sparkSession
    found = sampled(docs, graded, id_col, text, sample)
    by_row = sorted((r.row, r.grade) for r in found.where("feature = ''").select("row", "grade").toLocalIterator())
    grade = np.array([g for _, g in by_row])
    n = len(grade)
    if n == 0 or grade.min() == grade.max():
        return Model({}, [])
    found = found.where("feature <> ''")
    rare = cut(found.groupBy("f").agg(F.min("feature").alias("feature"), F.sqrt(F.log(F.lit(n) / F.count("*")) + 0.1).alias("rarity")))
    scaled = cut(
        found.select("row", "f", "n").join(sized(rare.select("f", "rarity"), rare.count()), "f").select(
            "row", "f", (F.log1p("n") * F.col("rarity")).alias("x")
        )
    )

    names, rarity, known = [], [], []  # of the working set
    rows, cols, values = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    weights, cuts, score = np.zeros(0), first_cuts(grade), np.zeros(n)
    while True:
        by_score = spark.createDataFrame(enumerate(slopes(score, cuts, grade)[0].tolist()), "row int, slope double")
        slope = scaled.join(F.broadcast(by_score), "row").groupBy("f").agg(F.abs(F.sum(F.col("x") * F.col("slope"))).alias("slope"))
        over = slope.where(F.col("slope") > penalty * (1 + SLACK))
        if known:
            over = over.join(F.broadcast(spark.createDataFrame([(f,) for f in known], "f long")), "f", "left_anti")
        entering = over.orderBy(F.desc(F.round("slope", 12)), "f").limit(together)  # the others come later
        entering = entering.join(rare, "f").select("f", "feature", "rarity").collect()
        if not entering:
            break
        names += [r.feature for r in entering]
        rarity += [r.rarity for r in entering]
        entering = [r.f for r in entering]
        numbered = F.broadcast(spark.createDataFrame([(f, len(known) + i) for i, f in enumerate(entering)], "f long, col int"))
        more = scaled.join(numbered, "f").select("row", "col", "x").toArrow()
        order = np.lexsort((more["row"].to_numpy(), more["col"].to_numpy()))
        rows, cols, values = (np.r_[old, more[c].to_numpy()[order]] for old, c in ((rows, "row"), (cols, "col"), (values, "x")))
        known += entering
        weights, cuts = fit(rows, cols, values, grade, len(known), penalty=penalty, start=(np.r_[weights, np.zeros(len(entering))], cuts))
        score = np.bincount(rows, values * weights[cols], n)
    return Model({f: float(x * r) for f, x, r in zip(names, weights, rarity) if x}, cuts.tolist())


def score(docs: DataFrame, model: Model, text: str = "text", severity: str = "severity", p_above: str = "p_above") -> DataFrame:
    """``docs`` with columns of these names: the expected grade, and the probabilities of exceeding each grade; columns of
    ``docs`` that have the names are replaced. The features of a whole text are counted before the logarithm."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's features

    def run(texts: list[str | None], own: dict[str, tuple]) -> np.ndarray:
        """Probabilities by text. ``own`` is the memo from word to those of its features that have weights."""
        weights, cuts = held.value.weights, np.array(held.value.thresholds)
        sums = np.zeros(len(texts))
        for i, body in enumerate(texts):
            found: dict[str, int] = {}
            for word, n in Counter(_WORDS((body or "").lower())).items():
                if (telling := own.get(word)) is None:
                    if len(own) >= MEMO:
                        own.clear()
                    own[word] = telling = tuple(f for f in features_of(word) if f in weights)
                for f in telling:
                    found[f] = found.get(f, 0) + n
            sums[i] = sum(weights[f] * np.log1p(n) for f, n in sorted(found.items()))
        return _logistic(sums[:, None] - cuts)

    keep = all_but(docs, severity, p_above)
    at = keep.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        own: dict[str, tuple] = {}
        for part in (part for batch in batches for part in parts_of(batch, at)):
            p = run(part.column(at).to_pylist(), own)
            yield [*part.columns, pa.array(p.sum(1)), pa.array(p.tolist(), pa.list_(pa.float64()))]

    return map_batches(docs.select(*map(quoted, keep)), keep, scored, **{severity: DoubleType(), p_above: ArrayType(DoubleType())})


def toxic(severity: Column) -> Column:
    return severity >= REJECT


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, grades(table(spark, sf_dir, "labels")))
    found = score(docs, model).drop("text")
    return found.select(
        "doc_id", F.round("severity", 6).alias("severity"), F.size(F.filter("p_above", lambda p: p >= 0.5)).alias("grade"),
        toxic(F.col("severity")).alias("toxic")
    )
