"""Operator 11 against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructType

from shelfspark.llm import periodic_runs as pr

DOCS = StructType().add("doc_id", LongType()).add("text", StringType())


def brute(words, least=pr.LEAST, exponent=pr.EXPONENT):
    """(start, length, smallest period) of all runs, by every period and place."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= exponent * q:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items() if b - a >= max(least, exponent * q))


def damaged(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = damaged(doc_id, text)
    runs = brute(words)
    gone = {i for a, k, q in runs for i in range(a + q, a + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{k},{q}\n" for a, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def made(rng, n):
    """Words with repeated stretches, within which there are repeated stretches again."""
    words = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, q = rng.randrange(len(words)), rng.choice([1, 2, 3, 5, 8, 12, 13, 24, 40])
        block = words[a : a + q]
        if rng.random() < 0.5 and len(block) > 4:
            block = block[:2] * (len(block) // 2)
        words[a:a] = block * rng.randrange(2, 7)
    return words


@pytest.mark.parametrize("seed", range(150))
def test_all_runs(seed):
    rng = random.Random(seed)
    words = made(rng, rng.randrange(1, 200))
    got = sorted((a, b - a, q) for a, b, q in pr.all_runs(np.array(words, np.int64)))
    assert got == brute(words, 1), words


def test_synchronising_sets():
    """Equal contexts are selected alike, and places without a selected one are highly periodic."""
    rng = random.Random(5)
    words = made(rng, 150) + made(rng, 150)
    array, n = np.array(words, np.int64), len(words)
    runs = [(a, a + k, q) for a, k, q in brute(words, 1)]
    hashes, scale = pr._mixed(array.astype(np.uint64)), 1
    while scale < 16:
        hashes, scale = pr._longer(hashes, scale), 2 * scale
        if scale < pr.BASE:
            continue
        places = set(pr.selected(hashes, scale, runs, n).tolist())
        by_context = {}
        for i in range(n - 2 * scale + 1):
            by_context.setdefault(tuple(words[i : i + 2 * scale]), set()).add(i in places)
        assert all(len(x) == 1 for x in by_context.values())
        period = lambda x: next(q for q in range(1, len(x) + 1) if x[q:] == x[:-q])
        for i in range(n - 3 * scale + 2):
            if not any(j in places for j in range(i, i + scale)):
                assert 3 * period(words[i : i + 3 * scale - 1]) <= scale


def test_query(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(f"w{x}" for x in made(rng, rng.randrange(1, 120))) for _ in range(60)]
    texts += [None, "", " \t\n", "a", "a " * 5000, " x " * 30, texts[0], texts[0], " ".join(map(str, range(3000))) + " end" * 30, "b\x00 c\n" * 24]
    rows = [*enumerate(texts), (None, texts[1]), (3, texts[3])]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [(i, *expected(i, t)) for i, t in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert sum(r[1] for r in want) > 20


def test_general_interface(spark):
    """Extra columns pass, with any names; the operator's own names are replaced."""
    docs = spark.createDataFrame([("x", 1, "a b " * 12, 7), ("y", 2, None, 8)], "`a.b` string, runs int, text string, c0 int")
    got = {r["a.b"]: r for r in pr.find_runs(docs).collect()}
    assert got["x"]["c0"] == 7 and [tuple(r) for r in got["x"]["runs"]] == [(0, 24, 2)] and got["x"]["collapsed"] == "a b"
    assert got["y"]["n_words"] == 0 and got["y"]["runs"] == [] and got["y"]["collapsed"] == ""
    assert pr.find_runs(docs.limit(0)).count() == 0
