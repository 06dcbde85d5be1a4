"""Near duplicates by verified Jaccard similarity against brute force."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as P
from shelfspark.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(30)]
    shared = [word() for _ in range(40)]
    texts = [*base, *(b + shared for b in base)]
    for i in range(160):
        t = list(base[i % 12])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    rows = [(i, " ".join(t) if i % 3 else "  ".join(t).upper(), "en", "a", 1) for i, t in enumerate(texts)]
    return rows + [(900, None, "en", "a", 1), (901, " ", "en", "a", 1), (902, "one two", "en", "a", 1), (903, "w " * 5000, "en", "a", 1)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def least_ids(rows):
    """Of each row, the smallest id of its component, and the numbers of links with and without near fingerprints."""
    sets = [shingles(r[1]) for r in rows]
    prints = [S.simhash(S.shingle_hashes((r[1] or "").encode())) for r in rows]
    root, far = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (prints[i] ^ prints[j]).bit_count() > 3
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return [min(least[find(i)]) for i in range(len(rows))], far


@pytest.mark.parametrize("crowd, sampled, most, dealt", [(40, 16, 1000, 1000), (2, 1, 1000, 3), (2, 1, 0, 3)])
def test_all_similar_pairs(spark, monkeypatch, crowd, sampled, most, dealt):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "SAMPLED", sampled)
    monkeypatch.setattr(S, "DEALT", dealt)
    rows = documents()
    want, far = least_ids(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, size=5, similarity=0.8, most=most).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)} and far > 50


def test_stage_drops_all_similar(spark, tmp_path):
    rows = documents()
    want, _ = least_ids(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/docs")
    kept = P.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_changed_copies_of_one_text_are_not_all_proposed(spark, monkeypatch):
    """Of many changed copies of one text, most meet the text itself, and few each other."""
    rng, proposed, plausible = random.Random(3), [], S._plausible

    def counted(pairs, *rest):
        pairs = S.cut(pairs)
        proposed.append(pairs.count())
        return plausible(pairs, *rest)

    monkeypatch.setattr(S, "_plausible", counted)
    monkeypatch.setattr(S, "SAMPLED", 1)
    base, texts = [f"w{i}" for i in range(150)], [[f"w{i}" for i in range(150)]]
    for i in range(300):
        t = list(base)
        for at in rng.sample(range(5, 145), i % 5 + 1):
            t[at] = f"x{rng.randrange(10**9)}"
        texts.append(t)
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    want, _ = least_ids(rows)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), size=5, similarity=0.8).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)}
    assert sum(proposed) < 5 * len(rows), proposed


def test_bitmaps_of_large_sets_differ():
    """Bitmaps differ in no more bits than the sets in shingles, and in most of these however large the sets are."""
    rng = random.Random(4)
    both = [rng.getrandbits(64) for _ in range(3000)]
    for n in (0, 1, 40, 100):
        a, b = ([*both, *(rng.getrandbits(64) for _ in range(n))] for _ in range(2))
        maps = [S.bitmap(S.np.unique(S.np.array(x, S.np.uint64))) for x in (a, b)]
        differ = sum(int(x).bit_count() for x in maps[0] ^ maps[1])
        assert 1.3 * n <= differ <= 2 * n
