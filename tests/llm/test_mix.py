"""Mixing sources to target weights (6) against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import source_mix as M

SCHEMA = "doc_id long, source string, text string, size long, key string"


def documents():
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", "é", "Z", None, "hot", "hot", "hot"]), "w\x0bx " * rng.randint(0, 30), -1, "k") for i in range(600)]
    rows += [(1000, "void", None, 3, "k"), (1001, "void", "", 3, "k"), (1002, "big", "w " * 30_000, 3, "k"), (1003, "tiny", "w", 3, "k"), rows[0], rows[0], (None, "a", "x y", 3, "k")]
    return rows


def reshared(sizes):
    """The rule, step by step."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, live = {}, 1.5 * sum(sizes.values()), set(names)
    while live:
        share = left / sum(weight[s] for s in live)
        full = {s for s in live if share * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in live}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        live -= full
    return target


@pytest.mark.parametrize("rows_in_range", [7, 4_000])
def test_mix(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(M, "RANGE_ROWS", rows_in_range)
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    run = lambda **k: M.mix(docs.repartition(6), M.n_words(F.col("text")), **k).collect()
    got = run()
    assert sorted(map(str, got)) == sorted(map(str, run()))
    assert sorted(str((r.doc_id, r.source, r.size)) for r in got) == sorted(str((i, s, len((t or "").split()))) for i, s, t, *_ in rows)
    sizes = {s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}}
    want = reshared(sizes)
    for s, size in sizes.items():
        of = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(want[s]) for r in of)
        assert abs(sum(r.taken for r in of) - want[s]) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 2 * r.size for r in of)
        epochs = int(want[s] // size) if size else 0
        assert sum(r.taken not in (epochs * r.size, (epochs + 1) * r.size) for r in of) <= 1
    largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for r in (by_doc := run(whole=True)):
        assert r.size == 0 or r.taken % r.size == 0
    assert all(abs(sum(r.taken for r in by_doc if r.source == s) - want[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA), F.col("size")).count() == 0


def test_all_sizes_zero(spark):
    got = M.mix(spark.createDataFrame([(1, "a", None, 0, "k"), (2, None, "", 0, "k")], SCHEMA), M.n_words(F.col("text"))).collect()
    assert [(r.target, r.taken) for r in got] == [(0, 0)] * 2
