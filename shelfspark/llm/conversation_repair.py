"""Operator 13: conversations repaired by depth-first branch and bound.

A conversation's rows must end in roles whose initials are ``(s?(ua)+)?``. Each row is kept, given the other role or deleted,
and rows without text are inserted; blank and repeated rows have to be deleted, and a row that ends without a full stop costs
extra unless it is. The cheapest edits win, of equally cheap ones those whose initials (Delete, Insert, Keep, Rerole) come
first in ASCII.

1. Spark finds each row's fault and place: rows move without their texts, as hashes, to their conversation.
2. A conversation of over ``PIECE`` rows is cut into pieces, which are dealt to many tasks. A piece is solved for each pair of
   states before and after it (a first piece has one before, a last piece any that may end), by a search with an explicit stack,
   cheapest child first:
   - a suffix's bound is what its rows cost each on their own, and what disjoint pairs of neighbours cost that can't both be
     kept side by side: a matching of greatest weight on the path of the rows that are left, from the state to the goal;
   - the incumbent is the cheapest (cost, audit) that reached the goal; a prefix whose bound exceeds it is left, as is one of
     equal cost whose audit can't come before it;
   - each node (row, state) keeps the best (cost, audit) that reached it, and prefixes no better than that are left. This is
     sound for ties, too: of two prefixes with the same cost at one node neither begins with the other.
   When the stack is empty the incumbent is proved. Pieces are joined state by state.
3. Rows meet their conversation's audit in the order of turns, as a stream: one task holds an audit and a batch of rows,
   never a conversation's texts.

Defined results: null roles and texts are one space; null turns come first and count in no gap; rows of one turn are ordered
by role, then by the text's SHA-256. A role without characters is like any other that is neither system, user nor assistant.
A null conversation id is a conversation. Repeated rows are duplicates of the first. An empty table gives an empty result;
extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import quoted, table

#: Rows of a conversation that are searched together.
PIECE = 32

# Costs of the edits, characters that end a sentence, white space, neighbours of a legal conversation.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
ENDS, SPACE = (".", "!", "?"), " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")

# States: nothing yet, after s, after u, after a, and any state that may end a conversation.
START, SYSTEM, USER, ASSISTANT, END = range(5)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The initial that an inserted or rerolled row takes in each state.
OTHER = "uuau"
ROLES = {"u": "user", "a": "assistant"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LAST = (START, ASSISTANT)
NEVER = 10**9

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# Search ----------------------------------------------------------------------------------------------------------


def _inserts(a: int, b: int) -> int:
    """Inserted rows that lead from a state to another."""
    for n in range(3):
        if a == b:
            return n
        a = NEXT[a][OTHER[a]]
    return NEVER


INSERTS = [[_inserts(a, b) for b in range(4)] for a in range(4)]


def possible(a: int, b: int) -> bool:
    """Whether some rows may lead from a state to another."""
    return a == b or a < b or (a, b) == (ASSISTANT, USER)


class Bounds:
    """Lower bounds of the cost from each row and state to the goals. A row is (initial, must go, cut off). Where something was
    kept already, rows of s can't be kept."""

    def __init__(self, rows: list[tuple[str, bool, bool]], goals: tuple[int, ...]):
        self.goals, self.n = goals, len(rows)
        self.alive = [any(possible(s, g) for g in goals) for s in range(4)]
        begun = self._bounds([(c.replace("s", " "), gone, short) for c, gone, short in rows])
        self.of = [self._bounds(rows), begun, begun, begun]

    def _bounds(self, rows: list[tuple[str, bool, bool]]) -> tuple[list, ...]:
        n = self.n
        alone = [0] * (n + 1)  # what the rows cost each on its own
        after = [n] * (n + 1)  # the next row that may stay
        extra = [0] * n  # what not keeping a row costs more
        matched, free = [0] * (n + 1), [0] * (n + 1)  # the greatest matching, and that without the next row
        for i in range(n - 1, -1, -1):
            initial, gone, short = rows[i]
            known = initial in AFTER
            alone[i] = alone[i + 1] + (DELETE if gone else CUT_OFF * short if known else min(REROLE + CUT_OFF * short, DELETE))
            extra[i] = min(REROLE, DELETE - CUT_OFF * short)
            if gone:
                after[i], matched[i], free[i] = after[i + 1], matched[i + 1], free[i + 1]
                continue
            after[i], free[i], j = i, matched[i + 1], after[i + 1]
            pair = 0
            if known and j == n:
                pair = 0 if AFTER[initial] in self.goals else min(INSERT, extra[i])
            elif known and rows[j][0] in AFTER and initial + rows[j][0] not in LEGAL:
                pair = min(INSERT, extra[i], extra[j]) + free[j]
            matched[i] = max(free[i], pair)
        return rows, alone, after, extra, matched, free

    def __call__(self, i: int, state: int) -> int:
        if not self.alive[state]:
            return NEVER
        rows, alone, after, extra, matched, free = self.of[state]
        j = after[i]
        if j == self.n:
            return alone[i] + INSERT * min(INSERTS[state][g] for g in self.goals)
        initial = rows[j][0]
        if initial in NEXT[state] or initial not in AFTER:
            return alone[i] + matched[i]
        return alone[i] + max(matched[i], min(INSERT, extra[j]) + free[j])


def cheapest(
    rows: list[tuple[str, bool, bool]], start: int = START, goals: tuple[int, ...] = LAST, steps: list[int] | None = None
) -> tuple[int, str] | None:
    """(cost, audit) of the best edits from a state to one of the goals, or None if no edits lead there. ``steps`` gets the
    number of prefixes that were looked at."""
    bound, n, looked = Bounds(rows, goals), len(rows), 0
    best: tuple[int, str] | None = None
    reached = {(0, start): (0, "")}
    stack = [(0, start, 0, "")]

    def hopeless(total: int, audit: str) -> bool:
        return total >= NEVER or best is not None and (total, audit) >= (best[0], best[1][: len(audit)] + "~")

    while stack:
        i, state, cost, audit = stack.pop()
        looked += 1
        if reached[i, state] != (cost, audit) or hopeless(cost + bound(i, state), audit):
            continue
        if i == n and state in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        other = NEXT[state][OTHER[state]]
        children = [(cost + INSERT, audit + "I", i, other)]
        if i < n:
            initial, gone, short = rows[i]
            children.append((cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                children.append((cost + REROLE + CUT_OFF * short, audit + "R", i + 1, other))
                if initial in NEXT[state]:
                    children.append((cost + KEEP + CUT_OFF * short, audit + "K", i + 1, NEXT[state][initial]))
        order = []
        for spent, made, row, then in children:
            total, held = spent + bound(row, then), reached.get((row, then))
            if not hopeless(total, made) and (held is None or (spent, made) < held):
                reached[row, then] = spent, made
                order.append((total, made, row, then, spent))
        stack.extend((row, then, spent, made) for _, made, row, then, spent in sorted(order, reverse=True))
    if steps is not None:
        steps.append(looked)
    return best


def solved(rows: list[tuple[str, bool, bool]], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a piece, for all states before and after it."""
    out = []
    for a in (START,) if first else range(4):
        for b in (END,) if last else range(4):
            found = cheapest(rows, a, LAST if last else (b,))
            if found:
                out.append((a, b, *found))
    return out


def joined(pieces: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from those of its pieces in order."""
    held: dict[int, tuple[int, str]] = {START: (0, "")}
    for results in pieces:
        now: dict[int, tuple[int, str]] = {}
        for a, b, cost, audit in results:
            if a in held and (b not in now or held[a][0] + cost <= now[b][0]):
                whole = held[a][0] + cost, held[a][1] + audit
                now[b] = min(now.get(b, whole), whole)
        held = now
    return min(held[s] for s in (*LAST, END) if s in held)


# Jobs ------------------------------------------------------------------------------------------------------------


def _plain(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, gone: Column | None = None) -> DataFrame:
    """conv, turn, role, text, gone (a row that only says that its conversation exists) and the text's hash."""
    return rows.select(
        quoted(conv_id).alias("conv"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role), F.lit(" ")).alias("role"),
        F.coalesce(quoted(text), F.lit(" ")).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _sorted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in [*keys, *order]))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each value of the first columns, of sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], kind: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)


def faults(rows: DataFrame) -> DataFrame:
    """Each row's place ``n`` in its conversation and its first fault. Texts stay behind."""
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.where("not gone").select(
        "conv", "turn", "role", "digest", F.left("role", F.lit(1)).alias("initial"), (ended == "").alias("blank"),
        (~F.right(ended, F.lit(1)).isin(*ENDS)).alias("short"),
    )
    by_turn = w.Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    same = w.Window.partitionBy("conv", "role", "digest").orderBy("n")
    placed = light.withColumns(
        {"n": F.row_number().over(by_turn) - 1, "before": F.lag("initial").over(by_turn), "turn_before": F.lag("turn").over(by_turn)}
    )
    placed = placed.withColumn("duplicate", ~F.col("blank") & (F.row_number().over(same) > 1))
    return placed.select(
        "conv", F.floor(F.col("n") / PIECE).alias("piece"), "n", "initial", "blank", "duplicate",
        (F.col("short") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"),
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)).alias("illegal"), "turn",
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def assessed(rows: DataFrame) -> DataFrame:
    """(conv, COUNTS, audit) of each conversation with rows."""
    conv = rows.schema["conv"]
    long = lambda *names: [StructField(n, LongType()) for n in names]
    result = StructType([*long("a", "b", "cost"), StructField("audit", StringType())])
    piece = StructType([
        conv, *long("piece", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last"), StructField("results", ArrayType(result))
    ])
    whole = StructType([conv, *long(*COUNTS), StructField("audit", StringType())])
    piece_kind, whole_kind = to_arrow_schema(piece), to_arrow_schema(whole)

    def solve(found: list[tuple]) -> tuple:
        key, number = found[0][:2]
        _, _, _, initial, blank, duplicate, truncated, illegal, turn, new = zip(*found)
        results = solved(list(zip(initial, map(max, blank, duplicate), truncated)), number == 0, len(found) < PIECE)
        known = [t for t in turn if t is not None]
        ends = (known[0], known[-1]) if known else (None, None)
        results = [dict(zip(("a", "b", "cost", "audit"), r)) for r in results]
        return key, number, sum(blank), sum(duplicate), sum(truncated), sum(illegal), sum(new), *ends, results

    def join(found: list[tuple]) -> tuple:
        key, (_, _, blank, duplicate, truncated, illegal, turns, first, last, results) = found[0][0], zip(*found)
        known = [x for x in (*first, *last) if x is not None]
        gaps = max(known) - min(known) + 1 - sum(turns) if known else 0
        cost, audit = joined([tuple(r[k] for k in ("a", "b", "cost", "audit")) for r in rs] for rs in results)
        return key, gaps, sum(blank), sum(duplicate), sum(truncated), sum(illegal), cost, audit

    pieces = _sorted(faults(rows), ["conv", "piece"], ["n"]).mapInArrow(
        lambda batches: _batches(map(solve, _groups(batches, 2)), piece_kind), piece
    )
    return _sorted(pieces, ["conv"], ["piece"]).mapInArrow(
        lambda batches: _batches(map(join, _groups(batches, 1)), whole_kind), whole
    )


def _edited(rows: DataFrame) -> DataFrame:
    """A row of place 0 with the counts and the audit for each conversation, followed by its repaired rows in order. Each
    partition holds whole conversations."""
    found = assessed(rows).withColumns({"kind": F.lit(0), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    texts = rows.withColumns({"kind": F.lit(1), **{c: F.lit(None).cast("long") for c in COUNTS}, "audit": F.lit(None).cast("string")})
    columns = ["conv", "kind", "turn", "role", "text", "gone", *COUNTS, "audit"]
    both = found.withColumns(
        {"turn": F.lit(None).cast("long"), "gone": F.lit(False), "digest": F.lit(None).cast("binary")}
    ).select(*columns, "digest").unionByName(texts.select(*columns, "digest"))
    out = StructType([
        rows.schema["conv"], StructField("place", IntegerType()), StructField("turn", LongType()), StructField("edit", StringType()),
        StructField("role", StringType()), StructField("text", StringType()), *(StructField(c, LongType()) for c in COUNTS),
        StructField("audit", StringType()),
    ])
    kind_of = to_arrow_schema(out)
    nothing = (None,) * (len(COUNTS) + 1)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        begun, key, audit, at, place, state = False, None, "", 0, 0, START

        def inserted() -> Iterator[tuple]:
            nonlocal at, place, state
            while at < len(audit) and audit[at] == "I":
                role = OTHER[state]
                at, place, state = at + 1, place + 1, NEXT[state][role]
                yield key, place, None, "insert", ROLES[role], "", *nothing

        for batch in batches:
            for conv, kind, turn, role, text, gone, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != key:
                    if begun:
                        yield from inserted()
                    begun, key, audit, at, place, state = True, conv, more[-1] or "", 0, 0, START
                    yield key, 0, None, None, None, None, *(x or 0 for x in more[:-1]), audit
                if kind == 0 or gone:
                    continue
                yield from inserted()
                do, at = audit[at], at + 1
                if do == "D":
                    continue
                initial = OTHER[state] if do == "R" else role[0]
                place, state = place + 1, NEXT[state][initial]
                yield key, place, turn, "rerole" if do == "R" else "keep", ROLES[initial] if do == "R" else role, text, *nothing
        if begun:
            yield from inserted()

    return _sorted(both, ["conv"], ["kind", "turn", "role", "digest"]).drop("digest").mapInArrow(
        lambda batches: _batches(edit(batches), kind_of, 200), out
    )


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of the repaired conversations: the id, place (from 1), turn (null if inserted), edit (keep, rerole, insert), role
    and text."""
    out = _edited(_plain(rows, conv_id, turn, role, text)).where("place > 0")
    return out.select(F.col("conv").alias(conv_id), "place", F.col("turn").alias(turn), "edit", F.col("role").alias(role), F.col("text").alias(text))


# The query -------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by the id's and turn's CRC-32: dropped rows stay as signs that their conversation exists."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (
        F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    ).alias("case"))
    changed = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        (F.col("case") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1))).alias("copy"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    edited = _edited(_plain(rows, "conv_id", "turn", "role", "text", F.col("gone"))).select("conv", "place", *COUNTS, "audit", "role", "text")
    out = StructType([
        StructField("conv_id", edited.schema["conv"].dataType), *(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType()),
        StructField("repaired_sha256", StringType()),
    ])
    kind = to_arrow_schema(out)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head, sha = None, hashlib.sha256()
        for batch in batches:
            for conv, place, *found, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    if head:
                        yield *head, sha.hexdigest()
                    head, sha = (conv, *found), hashlib.sha256()
                else:
                    sha.update(f"{chr(10) * (place > 1)}{role}:{text}".encode())
        if head:
            yield *head, sha.hexdigest()

    return edited.mapInArrow(lambda batches: _batches(digests(batches), kind), out)
