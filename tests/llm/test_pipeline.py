"""The corpus pipeline's stages against brute force, and the registered queries."""

import collections
import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from shelfspark.llm import byte_bpe as B
from shelfspark.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(15, 150)) for _ in range(250)]
    toxic = [i for i in range(250) if i % 6 == 0]
    for i in toxic:
        texts[i] += " nastyword " * 3 + words(rng, 3)
    rows = [(i, t, "en", rng.choice(["a", "b", "hot", "hot", "hot", None]), len(t), "r") for i, t in enumerate(texts)]
    rows += [(300 + i, texts[i + 1].upper() if i % 2 else texts[i + 1], "en", "a", 1, "r") for i in range(0, 40, 4)]
    near = words(rng, 400).split()
    for i in range(12):
        copy = list(near)
        copy[rng.randrange(400)] = "changed"
        rows.append((500 + i, " ".join(copy), "en", "hot", 1, "r"))
    rows += [(900, None, None, None, None, None), (901, "", "en", "a", 0, "r"), (902, "é 🙂", "en", "a", 3, "r"), (903, "w " * 30_000, "en", "big", 1, "r"), rows[7], rows[7], (None, texts[1], "en", "a", 1, "r"), (None, None, None, None, None, None)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(250) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, toxic


def lower(text):
    return (text or "").encode().lower()


def shingles(text):
    w = lower(text).split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def test_stages(spark, folder, tmp_path):
    at, rows, toxic = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    held = {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns, name
        held[k] = [tuple(r) for r in docs.collect()]

    count = lambda data: collections.Counter(r[:2] for r in data)
    assert not {r[0] for r in held[0]} & set(toxic) and len(held[0]) >= len(rows) - len(toxic) - 2 and not count(held[0]) - count(rows)

    largest = {}
    for r in held[0]:
        largest[lower(r[1])] = max(largest.get(lower(r[1]), -1), -1 if r[0] is None else r[0])
    assert sorted((lower(r[1]), -1 if r[0] is None else r[0]) for r in held[1]) == sorted(largest.items())

    sets = [shingles(r[1]) for r in held[1]]
    root = list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(held[1]):
        least[find(i)] = min(least.get(find(i), r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert count(held[2]) == count(least.values()) and len(held[2]) < len(held[1])

    times, size = count(held[3]), collections.Counter()
    assert set(times) <= set(count(held[2])) and max(times.values()) <= 2
    for r in held[2]:
        size[r[3]] += len(lower(r[1]).split())
    taken = collections.Counter()
    for r in held[3]:
        taken[r[3]] += len(lower(r[1]).split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 40_000 and all(taken[s] <= 2 * size[s] for s in size)

    import public_tokenizers
    import tiktoken

    tokens = B.read_ranks(B.vocabulary_path())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = sorted(str((r[0], own.encode_ordinary(r[1] or ""))) for r in held[3])
    assert sorted(str((r[0], list(r[4]))) for r in held[4]) == want
    # Stages are the same each time, whatever files they read.
    assert sorted(map(str, map(tuple, P.run(spark, at).collect()))) == sorted(map(str, held[4]))


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {"op1_secret_scan", "op4_url_filter", "op10_exact_dedup", "op12_embedding_dedup"}


def test_columns_of_the_scores_names(spark, folder):
    """Columns that are called like the scores keep their values and types."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").selectExpr("*", "'mild' as severity", "doc_id as P_ABOVE")
    kept = P.drop_toxic(spark, docs, folder[0])
    assert kept.dtypes == docs.dtypes and {r.severity for r in kept.collect()} == {"mild"}
