"""Operator 12 against brute force."""

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, LongType, StructType

from shelfspark.llm import embedding_dedup as ed
from shelfspark.llm.embedding_dedup import at_cosine

ROWS = StructType().add("vec_id", LongType()).add("embedding", ArrayType(FloatType()))


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x)


def brute(rows, cosine=ed.COSINE):
    """(id, n_links, component_id, kept) of each row."""
    good = [i for i, (_, x) in enumerate(rows) if usable(x)]
    linked = {i: set() for i in range(len(rows))}
    for length in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= cosine).tolist():
            if a != b:
                linked[own[a]].add(own[b])
    out, root = [], {}
    for i in range(len(rows)):
        if i not in root:
            seen, todo = {i}, [i]
            while todo:
                fresh = linked[todo.pop()] - seen
                seen |= fresh
                todo += fresh
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            root |= {j: min(ids, default=None) for j in seen}
        out.append((rows[i][0], len(linked[i]), root[i], rows[i][0] == root[i]))
    return out


@pytest.mark.parametrize("size", [2, 8, 24, 64])
def test_recall(size):
    """Pairs at exactly the asked cosine share a filter."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = ed.plan_for(size, 3_000, ed.COSINE)
    pad = lambda v: np.pad(v, ((0, 0), (0, plan.size - size)))
    met = lambda cosine: len(set(np.concatenate(list(ed.sharing(pad(x), pad(at_cosine(rng, x, cosine)), plan))).tolist())) / len(x)
    assert met(ed.COSINE) > 0.99 and met(0.96) > 0.999


def test_decoding_lists_all():
    rng = np.random.default_rng(2)
    plan = ed.Plan(24, 0.45, 5, 3, 1)
    x = rng.standard_normal((40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    products = [x @ m for m in ed._code(plan, 0)]
    total = products[0][:, :, None, None] + products[1][:, None, :, None] + products[2][:, None, None, :]
    want = {(int(i), int((a * 5 + b) * 5 + c)) for i, a, b, c in np.argwhere(total >= plan.alpha)}
    assert set(zip(*map(np.ndarray.tolist, ed.decoded(x, plan, 0)))) == want and want


def planted(seed=3):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal((6, 32)))
    vectors = [*unit(rng.standard_normal((300, 32)))]
    vectors += [*at_cosine(rng, np.repeat(centre[:1], 120, 0), 0.995)]  # one ball
    vectors += [*at_cosine(rng, np.repeat(centre[1:2], 90, 0), 0.955)]  # links of about 0.912, too wide for a ball
    vectors += [*at_cosine(rng, np.repeat(at_cosine(rng, centre[2:3], 0.93), 60, 0), 0.999), *at_cosine(rng, np.repeat(centre[2:3], 60, 0), 0.999)]  # two balls
    vectors += [centre[3]] * 200 + [*at_cosine(rng, np.repeat(centre[3:4], 3, 0), 0.93)]
    chain = [centre[4]]
    for _ in range(12):
        chain.append(unit(at_cosine(rng, chain[-1][None], 0.91))[0])
    vectors = [list(map(float, x)) for x in [*vectors, *chain]]
    odd = [None, [], [0.0] * 32, [1.0, None], [float("nan")] * 32, [float("inf")] + [0.0] * 31, [3.0], [5.0], [-1.0], [9.0, 3.0, 3.0, 1.0], [1.0, 0, 0, 0], [0.0, 0, 0, 2]]
    vectors += [list(map(lambda v: None if v is None else float(v), x)) if x else x for x in odd]
    order = rng.permutation(len(vectors)).tolist()
    rows = [(i, vectors[k]) for i, k in enumerate(order)]
    return rows + [(None, vectors[0]), (None, None), (7, rows[7][1]), (None, vectors[len(vectors) - 20])]


@pytest.mark.parametrize("most", [ed.BROADCAST_ROWS, 0])
def test_query(spark, tmp_path, most, monkeypatch):
    rows = planted()
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    if not most:
        monkeypatch.setattr(ed, "VECTOR_BYTES", 0)
        docs = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
        got = ed.near_vectors(docs, most=0).collect()
    else:
        got = ed.op12_embedding_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_balls_are_not_listed(spark):
    """The links of a ball are counted without pairs: no join makes more rows than its vectors have filters."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1, 32))
    x /= np.linalg.norm(x)
    many = at_cosine(rng, np.repeat(x, 1500, 0), 0.997)
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(many)], ROWS)
    seen = []
    real = ed.with_cosine
    try:
        ed.with_cosine = lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1]
        got = ed.near_vectors(rows).collect()
    finally:
        ed.with_cosine = real
    assert {r["n_links"] for r in got} == {1499} and sum(seen) < 40 * len(many)


def test_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [1.0, 0.1], 2)], "`v.id` string, vec array<double>, row int")
    got = {r["v.id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.near_vectors(rows, "v.id", "vec").collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False)}
    assert ed.near_vectors(rows.limit(0), "v.id", "vec").count() == 0
