"""Exact dedup (10) and SimHash near-dedup (7) against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from shelfspark.llm import common
from shelfspark.llm import exact_dedup as X
from shelfspark.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, fp string, id long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = [words(rng, rng.randint(0, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(100, 220):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if t:
                t[rng.randrange(len(t))] = words(rng, 1)
        rows.append((i, " ".join(t) if i % 3 else "  ".join(t).upper()))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "One"), (305, "one two"), (306, "É É É"), (307, "é é é"), (308, " a" * 40_000)]
    rows += [rows[3], rows[3], (None, base[3]), (None, "only null"), (None, "only null")]
    return [(i, t, "clash", 7) for i, t in rows]


def lower(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("most", [0, 1000])
def test_exact_groups(spark, most):
    rows = documents()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(str((i, largest[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest())) for i, t, *_ in rows)
    got = X.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), most=most).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) >> np.uint64(rng.integers(0, 60)) for _ in range(6)]
    merged = X.unpack(X.pack(X.merge([X.build_filter(p) for p in parts])))
    hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (X.hashes_of(merged) == hashes).all() and (merged[3] == counts).all()
    assert len(X.build_filter(parts[0][:0])[2]) == 0


@pytest.mark.parametrize("block_rows", [3, 50_000])
def test_repeated_fingerprints(spark, monkeypatch, block_rows):
    monkeypatch.setattr(X, "BLOCK_ROWS", block_rows)
    values = [random.Random(i % 90).getrandbits(64) - 2**63 for i in range(150)]
    got = {(r.fp, r.n) for r in X.repeated_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long").repartition(7), 150).collect()}
    assert got == {(v, values.count(v)) for v in values if values.count(v) > 1}


def fingerprint(text):
    w = [x for x in lower(text).split()]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("most", "crowd"), [(1000, 40), (0, 1), (1000, 1)])
def test_near_duplicates(spark, monkeypatch, most, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = documents()
    prints = [fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    want = sorted(str((r[0], prints[i], min((x for x in least[find(i)] if x is not None), default=None))) for i, r in enumerate(rows))
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), most=most).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == want
    assert len({find(i) for i in range(len(rows))}) < len(set(prints))  # some links join different fingerprints


def test_golay_keys_meet(spark):
    rng = random.Random(9)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        decoded, probed = (set(S.keys_of(np.array([x], np.uint64), probing)[1].tolist()) for x, probing in ((a, False), (b, True)))
        assert decoded & probed


def test_keys_of_many_at_once():
    fps = np.random.default_rng(3).integers(0, 2**64, 50, dtype=np.uint64)
    for probing in (False, True):
        owners, keys = S.keys_of(fps, probing)
        for i, fp in enumerate(fps):
            assert sorted(keys[owners == i]) == sorted(S.keys_of(fps[i : i + 1], probing)[1])


def test_crowded_keys_make_no_pairs_within_components(spark):
    """Fingerprints that differ in one bit of a few share keys; the edges stay far under all pairs."""
    fps = [(1 << a | 1 << b) for a in range(46, 64) for b in range(46, a)]
    edges = S.links(spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long"))
    roots = dict(S.components(edges).collect())
    assert len(set(roots.values())) == 1 and len(roots) == len(fps)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(i, 1000) for i in range(900, 1000)] + [(2000, 2001), (2000, 2001)]
    got = dict(S.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 900 for i in range(900, 1001)} | {2000: 2000, 2001: 2000}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.exact_groups(empty).count() == 0 and S.near_duplicates(empty).count() == 0
    assert S.near_duplicates(empty, size=5, similarity=0.8).count() == 0


def test_look_up_of_hot_keys(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, None if i % 7 == 0 else 5 if i % 3 else i) for i in range(300)]
    spark.createDataFrame(rows, "i long, k long").write.parquet(f"{tmp_path}/left")
    left, right = spark.read.parquet(f"{tmp_path}/left"), spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 2)] + [(5, "v5")], "k long, v string")
    want = sorted((i, None if k is None or (k % 2 and k != 5) else f"v{k}") for i, k in rows)
    for most in (0, 1000):
        assert sorted((r.i, r.v) for r in common.look_up(left, right, "k", 151, most).collect()) == want


def test_unique_texts_stay(spark, monkeypatch):
    """Beyond the broadcast, a bitmap is met before any exchange, and passes only what may be repeated."""
    monkeypatch.setattr(X, "PASS", 40)
    rows = [(i, f"text {i if i % 7 else i % 14}", "a", "x") for i in range(1400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    light = X.cut(X.fingerprints(docs, "doc_id", "text"))
    repeated = X.cut(light.groupBy("fp").count().where("count > 1").select("fp"))
    extra = X.cut(repeated.unionByName(spark.range(100).select(F.xxhash64("id").alias("fp"))))
    texts = X.maybe_repeated(X.fingerprints(docs, "doc_id", "text", keep_text=True), extra, 102)
    plan = texts.groupBy("fp", "norm").count()._jdf.queryExecution().executedPlan().toString()
    under = plan[plan.index("hashpartitioning(fp"):]
    assert plan.count("hashpartitioning") == 1 and under.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    found = [bytes(r.norm) for r in texts.collect()]
    assert sum(x in (b"text 0", b"text 7") for x in found) == 200 and len(found) < 300
    got = X.exact_groups(docs, most=0).where("group_size > 1").collect()
    assert len(got) == 200 and {r.keep_id for r in got} == {1386, 1393}
