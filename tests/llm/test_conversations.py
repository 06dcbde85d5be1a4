"""Operator 13 against shortest paths over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructType

from shelfspark.llm import conversation_repair as cr

ROWS = StructType().add("conv_id", LongType()).add("turn", LongType()).add("role", StringType()).add("text", StringType())


def best_edits(rows, start=cr.START, goals=cr.LAST):
    """(cost, audit) by states after each row, each with its least."""

    def inserted(held):
        while True:
            more = {s: min(held.get(s, (9e9,)), *((c + 3, a + "I") for p, (c, a) in held.items() if cr.NEXT[p][cr.OTHER[p]] == s), (9e9,)) for s in range(4)}
            more = {s: x for s, x in more.items() if x != (9e9,)}
            if more == held:
                return held
            held = more

    held = inserted({start: (0, "")})
    for initial, gone, short in rows:
        ways = [(s, (c + 4, a + "D")) for s, (c, a) in held.items()]
        if not gone:
            ways += [(cr.NEXT[s][cr.OTHER[s]], (c + 3 + 3 * short, a + "R")) for s, (c, a) in held.items()]
            ways += [(cr.NEXT[s][initial], (c + 3 * short, a + "K")) for s, (c, a) in held.items() if initial in cr.NEXT[s]]
        held = inserted({s: min(x for p, x in ways if p == s) for s, _ in ways})
    return min((held[g] for g in goals if g in held), default=None)


def damaged(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if case == 1:
        text = ""
    if case == 2:
        text = re.sub("[.!?]", "", text)
    if case == 4:
        role = "user"
    return [] if case == 0 else [(turn, role, text)] * (2 if case == 3 else 1)


def expected(conv, rows):
    rows = sorted((x for r in rows for x in damaged(conv, *r)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    counts, seen, coded = [0, 0, 0], set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        coded.append((role[:1], fault in (0, 1), fault == 2))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
    cost, audit = best_edits(coded)
    out, state, left = [], 0, iter(rows)
    for do in audit:
        _, role, text = ("", "", "") if do == "I" else next(left)
        if do != "D":
            initial = cr.OTHER[state] if do in "IR" else role[0]
            out.append(f"{cr.ROLES[initial] if do in 'IR' else role}:{text}")
            state = cr.NEXT[state][initial]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(40))
def test_search(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(rng.choice("suuaa x"[: rng.randrange(3, 8)]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(14))]
        for start in range(4):
            for goals in (cr.LAST, (0,), (1,), (2,), (3,)):
                assert cr.cheapest(rows, start, goals) == best_edits(rows, start, goals), (rows, start, goals)
        bound = cr.Bounds(rows, cr.LAST)
        for i in range(len(rows) + 1):
            assert all(bound(i, s) <= best_edits(rows[i:], s)[0] for s in range(4))
        pieces = [rows[i : i + 4] for i in range(0, len(rows) or 1, 4)]
        assert cr.joined(cr.solved(p, i == 0, i == len(pieces) - 1) for i, p in enumerate(pieces)) == best_edits(rows)


def test_few_prefixes_are_looked_at():
    rng, steps = random.Random(2), []
    for _ in range(50):
        cr.cheapest([(rng.choice("ua") if rng.random() < 0.2 else "ua"[i % 2], rng.random() < 0.1, rng.random() < 0.1) for i in range(cr.PIECE)], steps=steps)
    assert max(steps) < 40 * cr.PIECE


def test_query(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Good day.", "Good day. ", "no end", " \t\n", "", None, "x!\x0b", "Ends?", "é.", "a.b", "long " * 5000 + "."]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 3, 7, 8, 31, 32, 33, 70])):
            given = None if rng.random() < 0.03 else turn + rng.choice([0, 0, 0, 0, 1, 3])
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", None])
            rows.append((conv, given, role, f"{turn}." if rng.random() < 0.7 else rng.choice(texts)))
    alone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(alone, 0, "user", "Dropped.")]
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ROWS.add("TURNS", LongType())).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in cr.op13_conversation_repair(spark, str(tmp_path)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    want = [expected(conv, found) for conv, found in by_conv.items()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert next(r for r in got if r[0] == alone) == (alone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_general_interface(spark):
    rows = spark.createDataFrame([("c", 1, "user", "Hi.", 9), ("c", 2, "user", "Hi.", 9), ("c", 3, "system", "Be kind.", 9)], "`conv.id` string, no int, who string, text string, cost int")
    got = cr.repaired(rows, "conv.id", "no", "who").orderBy("place").collect()
    assert [(r["edit"], r["who"], r["text"], r["no"]) for r in got] == [("keep", "user", "Hi.", 1), ("rerole", "assistant", "Be kind.", 3)]
    assert cr.repaired(rows.limit(0), "conv.id", "no", "who").count() == 0
