"""Operator 3: language identification with a linear-chain conditional random field.

Words (runs of letters) form chains of up to ``CHAIN`` neighbours. A word's features are its form (the learned lexicon),
affixes of two and three letters and character trigrams, each with one weight for every language; learned transitions link
neighbours.
Forward-backward gives each word's language probabilities, so code-switched text gets its labels word by word; a document's
language is the one of the largest probability mass over all words of the whole text, and the score is its share.

The fit reads a bounded sample (``SAMPLE`` rows at most, taken evenly from all languages in hash order, whole texts) of rows
with a non-null language whose crc32(id) mod 4 is not 2. Languages are counted first, so that of each only rows of small hash
are ranked. Some training chains join segments of several documents, so that
transitions between languages are learned. Adam on the driver maximises the likelihood; features hash into ``WIDTH`` rows.

Defined results: ``und`` and score 0 for a null text, one without letters, or if nothing could be learned. A null id is
neither learned from nor held out; of labelled rows that share an id, one is learned from, with its own label and text.
Repeated rows get equal results; ties go to the first language in code-point order. Extra columns are kept, whatever their
names; an empty table gives an empty result. Texts of any length are labelled some ``TOGETHER`` words at a time.
"""

from __future__ import annotations

import random
import re
from itertools import chain as joined
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .common import BROADCAST_ROWS, all_but, cut, map_batches, parts_of, quoted, sized, table

SAMPLE, WIDTH, STEPS, DECAY, SEED = 800, 1 << 16, 40, 2e-6, 11

#: Words of a chain, and of a training segment, at most.
CHAIN, SEGMENT = 64, 20

#: Words that are labelled at a time, whole chains of them.
TOGETHER = 1 << 15
MEMO = 200_000
_WORDS = re.compile(r"[^\W\d_]+").findall


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def has_letter(words: list[str]) -> bool:
    return any(x.isalpha() or any(map(str.isalpha, x)) for x in words)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    total = np.uint64(0)
    for k, x in enumerate(parts):
        total = total + np.asarray(x, np.uint64) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (total >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in a row, and where those of each word begin."""
    marked = "".join([f"<{x}>" for x in words]).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(marked, "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    last = starts + sizes - 1
    place = np.arange(len(c)) - np.repeat(starts, sizes)
    c1, c2, c3 = (np.r_[c[k:], np.zeros(k, np.uint64)] for k in (1, 2, 3))
    with np.errstate(over="ignore"):
        # In the places of a word's marks and letters: its trigrams, then the word itself and an affix of three letters.
        found = _hash(1, c, c1, c2)
        power = (np.uint64(0x100000001B3) ** np.arange(int(sizes.max()), dtype=np.uint64))[place]
        found[last] = _hash(2, np.add.reduceat(c * power, starts))
        found[last - 1] = _hash(3, c, c1, c2, c3)[starts]  # leading letters; those of the end:
        trailing = _hash(4, c, c1, c2, c3)[np.maximum(last - 3, starts)]
    flat = np.empty(len(c) + len(words), np.int64)
    ends = last + np.arange(len(words)) + 1
    inner = np.ones(len(flat), bool)
    inner[ends] = False
    flat[inner], flat[ends] = found, trailing
    return flat, starts + np.arange(len(words))


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """(words, languages): sums of the weights of each word's features."""
    if not words:
        return np.zeros((0, weights.shape[1]), weights.dtype)
    flat, starts = features_of(words)
    return np.add.reduceat(weights[flat], starts, axis=0)


class Chains:
    """Chains of given lengths, laid out step by step: first the first words of all chains, longest chain first."""

    def __init__(self, lengths: np.ndarray):
        self.rank = np.argsort(-lengths, kind="stable")
        by_rank = lengths[self.rank]
        steps = int(by_rank[0]) if len(by_rank) else 0
        self.live = np.searchsorted(-by_rank, -np.arange(steps), side="left")  # chains longer than t
        self.at = np.r_[0, np.cumsum(self.live)]
        starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, np.int64)
        #: Places of the words, given chain after chain, in the layout.
        self.order = np.concatenate([starts[self.rank[: self.live[t]]] + t for t in range(steps)]) if steps else np.zeros(0, np.int64)

    def marginals(self, scores: np.ndarray, transitions: np.ndarray, expect: bool = False):
        """Posterior of each word (in the given order), the log likelihood's normaliser, expected transition counts."""
        move = np.exp(transitions)
        top = scores.max(1, keepdims=True)
        e = np.exp(scores - top)[self.order]
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
        steps = len(self.live)
        for t in range(steps):
            a, b = self.at[t], self.at[t + 1]
            now = e[a:b] if t == 0 else (alpha[self.at[t - 1] : self.at[t - 1] + b - a] @ move) * e[a:b]
            scale[a:b] = now.sum(1)
            alpha[a:b] = now / scale[a:b, None]
        counts = np.zeros_like(move)
        for t in range(steps - 1, 0, -1):
            a, b, p = self.at[t], self.at[t + 1], self.at[t - 1]
            ahead = e[a:b] * beta[a:b] / scale[a:b, None]
            beta[p : p + b - a] = ahead @ move.T
            if expect:
                counts += alpha[p : p + b - a].T @ ahead
        gamma = np.empty_like(e)
        gamma[self.order] = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        return gamma, float(np.log(scale).sum() + top.sum()), counts * move


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.weights, self.transitions = langs, weights.astype(np.float32), transitions

    def posteriors(self, texts: list[list[str]], memo: "Memo") -> np.ndarray:
        """Word posteriors of texts, one after the other. A text is cut into chains of ``CHAIN`` words."""
        words = list(joined.from_iterable(texts))
        if not words:
            return np.zeros((0, len(self.langs)))
        lengths = np.concatenate([np.r_[np.full(len(t) // CHAIN, CHAIN), len(t) % CHAIN] for t in texts])
        return Chains(lengths[lengths > 0]).marginals(memo.scores(words, self.weights), self.transitions)[0]


class Memo:
    """Scores of words that were seen lately."""

    def __init__(self, most: int = MEMO):
        self.most, self.places, self.rows = most, {}, None

    def scores(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        if new := set(words).difference(self.places):
            if len(self.places) + len(new) > self.most:
                self.places.clear()
                new = set(words)
            fresh, n = list(new), len(self.places)
            if self.rows is None or n + len(fresh) > len(self.rows):
                grown = np.empty((max(self.most, n + len(fresh)), weights.shape[1]), np.float32)
                grown[:n] = 0 if self.rows is None else self.rows[:n]
                self.rows = grown
            for at in range(0, len(fresh), 5000):
                part = fresh[at : at + 5000]
                self.rows[n + at : n + at + len(part)] = word_scores(part, weights)
            self.places.update(zip(fresh, range(n, n + len(fresh))))
        return self.rows[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].astype(np.float64)


def fit(rows: list[tuple[str, str]], steps: int = STEPS) -> Model | None:
    """From (language, text)."""
    langs = sorted({lang for lang, _ in rows})
    known = [
        (langs.index(lang), words[i : i + SEGMENT]) for lang,
        text in rows for words in [words_of(text)] for i in range(0, len(words), SEGMENT)
    ]
    if not known:
        return None
    rng = random.Random(SEED)
    rng.shuffle(known)
    chains: list[list[tuple[int, list[str]]]] = []
    for part in known:
        if chains and rng.random() < 0.3 and len(chains[-1]) < 3:
            chains[-1].append(part)
        else:
            chains.append([part])
    ids: dict[str, int] = {}
    places = np.array([ids.setdefault(x, len(ids)) for chain in chains for _, words in chain for x in words])
    gold = np.array([k for chain in chains for k, words in chain for _ in words])
    layout = Chains(np.array([sum(len(words) for _, words in chain) for chain in chains]))
    flat, starts = features_of(list(ids))
    owner = np.repeat(np.arange(len(ids)), np.diff([*starts, len(flat)]))
    n, k = len(gold), len(langs)
    ends = np.cumsum([sum(len(words) for _, words in chain) for chain in chains]) - 1
    inner = np.setdiff1d(np.arange(n), ends)
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[inner], gold[inner + 1]), 1)
    gold_by_word = np.stack([np.bincount(places[gold == c], minlength=len(ids)) for c in range(k)], 1)
    values = [np.zeros((WIDTH, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        scores = np.add.reduceat(values[0][flat], starts, axis=0)
        gamma, _, counts = layout.marginals(scores[places], values[1], expect=True)
        lack = gold_by_word - np.stack([np.bincount(places, gamma[:, c], len(ids)) for c in range(k)], 1)
        slope = [
            np.stack([np.bincount(flat, lack[owner, c], WIDTH) for c in range(k)], 1) / n - DECAY * values[0],
            (moves - counts) / n - DECAY * values[1]
        ]
        for v, g, m, s in zip(values, slope, first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9) * (np.abs(m) > 0)
    return Model(langs, values[0], values[1])


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    rows = docs.select(quoted(id_col).alias("id"), quoted(lang).alias("gold"), quoted(text).alias("text")).where(
        F.col("gold").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))
    )
    sizes = cut(rows.groupBy(F.col("gold").alias("of")).agg(F.count("*").alias("rows")))
    share = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) / (1 << 40)
    few = rows.select("id", "gold").join(
        sized(sizes, sizes.count(), BROADCAST_ROWS), F.col("gold") == F.col("of")
    ).where((F.col("rows") <= 4 * sample) | (share < 2 * sample / F.col("rows")))
    one = few.groupBy("id").agg(F.min("gold").alias("gold"))
    even = one.withColumn(
        "n", F.row_number().over(w.Window.partitionBy("gold").orderBy(F.xxhash64("id"), "id"))
    ).where(F.col("n") <= sample)
    picked = cut(even.orderBy("n", "gold").limit(sample).select("id", "gold"))  # the documented bound
    learned = rows.join(F.broadcast(picked), ["id", "gold"]).groupBy("id", "gold").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )
    return fit(sorted((r.gold, r.text) for r in learned.toLocalIterator()))


def _pieces(texts: list[list[str]]) -> Iterator[list[tuple[int, list[str]]]]:
    """The words of the texts in lists of about ``TOGETHER`` words; a text is cut between its chains."""
    held, n = [], 0
    for i, words in enumerate(texts):
        for at in range(0, len(words), TOGETHER):
            held.append((i, words[at : at + TOGETHER]))
            n += len(held[-1][1])
            if n >= TOGETHER:
                yield held
                held, n = [], 0
    if held:
        yield held


def _labelled(docs: DataFrame, model: Model | None, text: str, kinds: dict, build) -> DataFrame:
    """``docs`` with the columns ``kinds``, which build(model, texts, pieces) gives for some texts at a time; pieces are
    (place of the text, word posteriors), in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH times the number of languages
    keep = all_but(docs, *kinds)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        memo, model = Memo(), held.value

        def labelled(texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
            for piece in _pieces(texts):
                p, start = model.posteriors([words for _, words in piece], memo), 0
                for i, words in piece:
                    yield i, p[start : start + len(words)]
                    start += len(words)

        for part in (part for batch in batches for part in parts_of(batch, at)):
            texts = [words_of(x) for x in part.column(at).to_pylist()]
            columns = build(model, texts, labelled(texts) if model else ())
            yield [*part.columns, *(pa.array(c, to_arrow_type(kind)) for c, kind in zip(columns, kinds.values()))]

    return map_batches(docs.select(*map(quoted, keep)), keep, run, **kinds)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""

    def build(model, texts, pieces):
        mass = np.zeros((len(texts), len(model.langs) if model else 1))
        for i, p in pieces:
            mass[i] += p.sum(0)
        known = [bool(model) and has_letter(words) for words in texts]
        best = mass.argmax(1)
        return (
            [model.langs[k] if ok else "und" for k, ok in zip(best, known)],
            [min(1.0, float(m[k] / len(words))) if ok else 0.0 for m, k, ok, words in zip(mass, best, known, texts)],
        )

    return _labelled(docs, model, text, {"lang_pred": StringType(), "score": DoubleType()}, build)


def label_words(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with arrays words (lower-cased, in order), word_langs and word_scores."""

    def build(model, texts, pieces):
        langs, scores = ([[] for _ in texts] for _ in range(2))
        for i, p in pieces:
            langs[i] += [model.langs[k] for k in p.argmax(1)]
            scores[i] += p.max(1).tolist()
        if model is None:
            langs, scores = [["und"] * len(words) for words in texts], [[0.0] * len(words) for words in texts]
        return texts, langs, scores

    return _labelled(
        docs, model, text,
        {"words": ArrayType(StringType()), "word_langs": ArrayType(StringType()), "word_scores": ArrayType(DoubleType())}, build
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs)).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
