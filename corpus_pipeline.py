"""A training corpus from ``documents``, in five stages.

Each stage works on all rows that the one before kept: toxic documents go, then all but one of equal texts, then all but one
of each group of near duplicates; the sources are mixed to target weights, whole documents at a time and twice where an
epoch repeats; and the texts are encoded with byte-level BPE and decoded again. Stages 1 to 4 return the columns of ``documents``.

``run`` writes each stage's rows to the shared checkpoint folder and reads them again, as a lost executor must not cost the
stages before; what a stage wrote on the way goes with its end, and its rows once the next one's are written. Extra columns pass through the first four stages,
and empty tables through all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import byte_bpe, exact_dedup, simhash_dedup, source_mix, toxicity
from shelfspark.llm.common import columns_free_of, cut, quoted, remove, settled_at, sized, table
from shelfspark.shared import small_batches

#: Near copies: Jaccard similarity of the sets of runs of so many words.
NEAR_WORDS, NEAR = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the threshold. Learned from the labels of the input's own documents. A null,
    empty or wordless text has the severity of no feature; repeated rows are judged alike. Extra columns of any name pass through."""
    model = toxicity.train(docs, toxicity.grades(table(spark, sf_dir, "labels")))
    own = columns_free_of(docs, "score")
    scored = toxicity.score(docs, model, severity=own + "_severity", p_above=own + "_above")
    return scored.where(~toxicity.toxic(F.col(own + "_severity"))).select(*map(quoted, docs.columns))


def _numbered(docs: DataFrame, null_first: bool) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, in the order of doc_id: rows may share an id or have none. Stages read written
    rows, so a row gets the same number each time that it is read."""
    own = columns_free_of(docs, "row")
    known = F.col("doc_id").isNotNull() if null_first else F.col("doc_id").isNull()
    return docs.withColumn(own, F.struct(known.alias("k"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("n"))), own


def _without(docs: DataFrame, own: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``dropped``; the texts move only if those are too many to broadcast."""
    dropped = cut(dropped.select(F.col(f"{own}.n").alias(own + "_gone")))
    return docs.join(sized(dropped, dropped.count()), F.col(f"{own}.n") == F.col(own + "_gone"), "left_anti").drop(own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, a null one last; null counts as empty. Of rows that repeat all, one.
    Extra columns of any name pass through."""
    rows, own = _numbered(docs, True)
    return _without(rows, own, exact_dedup.exact_groups(rows, own).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest doc_id, a null one last. Texts without words are
    copies of each other. Extra columns of any name pass through."""
    rows, own = _numbered(docs, False)
    found = simhash_dedup.near_duplicates(rows, own, size=NEAR_WORDS, similarity=NEAR)
    return _without(rows, own, found.where(F.col(f"{own}.n") != F.col("component_id.n")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole documents at a time. Documents without words are never taken; a null
    source is a source; repeated rows are taken one by one."""
    rows, own = _numbered(docs, False)
    mixed = source_mix.mix(rows, source_mix.n_words(F.col("text")), own, key=F.col("doc_id"), whole=True).where("taken > 0")
    times = cut(mixed.select(F.col(f"{own}.n").alias(own + "_taken"), (F.col("taken") / F.col("size")).cast("int").alias(own + "_times")))
    joined = rows.join(sized(times, times.count()), F.col(f"{own}.n") == F.col(own + "_taken"))
    return joined.select(*map(quoted, docs.columns), F.explode(F.sequence(F.lit(1), F.col(own + "_times"))).alias(own + "_epoch")).drop(own + "_epoch")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids and the hash of the bytes that they decode to. A null text is empty; extra
    columns are left out, whatever their names."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("exact dedup", _stage(drop_copies)),
    ("near dedup", _stage(drop_near_copies)),
    ("source mix", _stage(mix_sources)),
    ("byte bpe", _stage(encode)),
]

#: Ordinal regression, SimHash and BPE have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = settled_at(spark, lambda stage=stage, docs=docs: (stage(spark, docs, sf_dir),))[0]
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
