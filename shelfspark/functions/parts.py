"""Strings that are looked for in many texts at a time. Most have no space, so they lie within a run between two spaces: each
distinct run of a batch is looked at once, and its texts are read off."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts, bytes of texts and cells (of parts and texts) that a task holds at a time.
ROWS, BYTES, CELLS = 20_000, 8 << 20, 1 << 25

#: In place of a distance where there is none.
NONE = 255


def gathered(batches: Iterator[pa.Array], rows: int = ROWS) -> Iterator[pa.Array]:
    """The same texts in order, in arrays of about so many rows or ``BYTES``; nulls are empty."""
    held, n, size = [], 0, 0
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows).fill_null("")
            held, n, size = [*held, part], n + len(part), size + part.nbytes
            if n >= rows or size >= BYTES:
                yield pa.concat_arrays(held)
                held, n, size = [], 0, 0
    if held:
        yield pa.concat_arrays(held)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs between spaces of some texts at a time; column ``run`` of the only column."""
    for texts in gathered(b.column(0) for b in batches):
        yield pa.record_batch({"run": pc.split_pattern(texts, " ").flatten().unique()})


#: Bytes of texts whose runs of characters are sorted at a time, some 100 bytes for each.
GRAM_BYTES = 1 << 20


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``GRAM_BYTES`` of text or one row; nulls are empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // GRAM_BYTES, prepend=-1))
    for at, end in zip(starts, [*starts[1:], len(batch)]):
        yield batch.slice(at, end - at)


def _listed(keys: np.ndarray, owners: np.ndarray, named: Callable[[np.ndarray], pa.Array], name: str, batch: pa.RecordBatch, scope: list[str]) -> pa.RecordBatch:
    """A row for each key and scope with the ``_row`` of the batch's rows that own it, and their number. Keys are from 0 on."""
    within = np.zeros(len(batch), np.int64)
    for c in scope:
        coded = batch.column(c).dictionary_encode(null_encoding="encode")
        within = np.unique(within * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(within, kind="stable")
    place = np.empty(len(batch), np.int64)
    place[order] = np.arange(len(batch))
    # One sort of numbers brings keys, in them scopes, and in those rows together.
    bits = len(batch).bit_length()
    pairs = np.sort((keys << bits) | place[owners])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    keys, at = pairs >> bits, order[pairs & ((1 << bits) - 1)]
    starts = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(within[at], prepend=-1) != 0))
    ends = np.r_[starts, len(at)].astype(np.int32)
    kept = {c: batch.column(c).take(pa.array(at[starts])) for c in scope}
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(batch.column("_row").to_numpy()[at]))
    return pa.record_batch({name: named(keys[starts]), **kept, "n": pa.array(np.diff(ends)), "rows": rows})


def grams(batches: Iterator[pa.RecordBatch], most: int, scope: list[str]) -> Iterator[pa.RecordBatch]:
    """(gram, scope, n, rows) of the runs of up to ``most`` (three at most) characters of ``hay``, some rows of _row, hay and scope at a time."""
    for batch in (piece for b in batches for piece in _pieces(b, "hay")):
        texts = batch.column("hay").fill_null("")
        sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
        letters, codes = np.unique(np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), return_inverse=True)
        owners, ends = np.repeat(np.arange(len(batch)), sizes), np.repeat(np.cumsum(sizes), sizes)
        base = len(letters)
        for n in range(1, most + 1):
            at = np.flatnonzero(np.arange(n, len(codes) + n) <= ends)
            keys = codes[at]
            for i in range(1, n):
                keys = keys * base + codes[at + i]
            distinct = None
            if base**n << len(batch).bit_length() >= 1 << 62:
                distinct, keys = np.unique(keys, return_inverse=True)

            def named(some: np.ndarray) -> pa.Array:
                some, which = np.unique(some if distinct is None else distinct[some], return_inverse=True)
                held = letters[np.stack([some // base**i % base for i in range(n)][::-1], axis=1)].tobytes().decode("utf-32-le")
                return pa.array([held[i : i + n] for i in range(0, len(held), n)], pa.string()).take(pa.array(which))

            if len(at):
                yield _listed(keys, owners[at], named, "gram", batch, scope)


def words(batches: Iterator[pa.RecordBatch], scope: list[str]) -> Iterator[pa.RecordBatch]:
    """(word, scope, n, rows) of the distinct ``words`` of some rows of _row, words and scope at a time."""
    for batch in batches:
        lists = batch.column("words")
        coded = lists.flatten().dictionary_encode()
        owners = np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy())
        yield _listed(coded.indices.to_numpy().astype(np.int64), owners, lambda some: coded.dictionary.take(pa.array(some)), "word", batch, scope)


class _Places:
    """Where bytes stand in strings that lie one after the other, read off from the places of each pair of bytes."""

    def __init__(self, strings: pa.Array):
        plain = strings.cast(pa.large_binary())
        ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
        held = plain.buffers()[2] if len(plain) else None
        self.data = np.frombuffer(held or b"", np.uint8)[ends[0] : ends[-1]]
        self.owners = np.repeat(np.arange(len(plain)), np.diff(ends))
        pairs = (self.data[:-1].astype(np.uint16) << 8) | self.data[1:]
        self.order = np.argsort(pairs, kind="stable")
        self.starts = np.r_[0, np.cumsum(np.bincount(pairs, minlength=1 << 16))]

    def having(self, part: bytes) -> np.ndarray:
        """The numbers of the strings with the part, which is not empty, as often as they have it."""
        if len(part) == 1:
            return self.owners[self.data == part[0]]
        pairs = [(part[i] << 8) | part[i + 1] for i in range(len(part) - 1)]
        _, first = min((self.starts[c + 1] - self.starts[c], i) for i, c in enumerate(pairs))
        at = self.order[self.starts[pairs[first]] : self.starts[pairs[first] + 1]] - first
        at = at[(at >= 0) & (at + len(part) <= len(self.data))]
        for i, byte in enumerate(part):
            if i not in (first, first + 1):
                at = at[self.data[at + i] == byte]
        which = self.owners[at]
        return which[which == self.owners[at + len(part) - 1]]


def _within(token: np.ndarray, words: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Which words, one in a column, are up to ``most`` edits or swaps of neighbours away. Cells off the diagonal by more don't count."""
    far = np.full(len(sizes), most + 1, np.uint8)
    before, last = {}, {}
    for i in range(len(token) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(words), i + most) + 1):
            if not i * j:
                now[j] = np.full(len(sizes), i + j, np.uint8)
                continue
            d = np.minimum(last.get(j, far), now.get(j - 1, far)) + np.uint8(1)
            np.minimum(d, last.get(j - 1, far) + (words[j - 1] != token[i - 1]), out=d)
            if i > 1 and j > 1:
                swapped = (words[j - 1] == token[i - 2]) & (words[j - 2] == token[i - 1])
                d = np.where(swapped, np.minimum(d, before.get(j - 2, far) + np.uint8(1)), d)
            now[j] = d
        before, last = last, now
    out = np.zeros(len(sizes), bool)
    for j, d in last.items():
        out |= (sizes == j) & (d <= most)
    return out


class Words:
    """Words to which tokens may be close."""

    def __init__(self, words: pa.Array):
        self.sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        owners = np.repeat(np.arange(len(words)), self.sizes)
        self.codes = np.zeros((int(self.sizes.max(initial=0)), len(words)), np.uint32)
        self.codes[np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes), owners] = codes
        # A bit for each character, by its code modulo 64: an edit changes one more or one less, a swap none.
        self.marks = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(self.marks, owners, np.uint64(1) << (codes % 64).astype(np.uint64))

    def near(self, token: str, most: int) -> np.ndarray:
        """Numbers of the words that are up to ``most`` edits or swaps of neighbours away."""
        own = Words(pa.array([token], pa.string()))
        mark = own.marks[0]
        met = abs(self.sizes - len(token)) <= most
        met &= (np.bitwise_count(self.marks & ~mark) <= most) & (np.bitwise_count(mark & ~self.marks) <= most)
        which = np.flatnonzero(met)
        return which[_within(own.codes[:, 0], self.codes[: len(token) + most, which], self.sizes[which], most)]


def distances(texts: pa.Array, parts: list[str], near: tuple[pa.Array, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """By part and text: 0 if the text contains the part, else the least distance from the part of a run that the text has, else
    ``NONE``. ``near`` holds runs, the numbers of their parts, and distances."""
    out = np.full((len(parts), len(texts)), NONE, np.uint8)
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    owners = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())[np.argsort(codes, kind="stable")]
    starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(distinct)))]

    def put(part: int | np.ndarray, which: np.ndarray, value: int) -> None:
        n = starts[which + 1] - starts[which]
        at = np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[part if isinstance(part, int) else np.repeat(part, n), owners[at]] = value

    if near is not None:
        at = pc.index_in(near[0], value_set=distinct.cast(near[0].type))
        here, at = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
        for value in sorted(set(near[2].tolist()), reverse=True):
            chosen = here & (near[2] == value)
            put(near[1][chosen], at[chosen], value)
    places = _Places(distinct)
    for number, part in enumerate(parts):
        if " " in part or not part:
            out[number, pc.match_substring(texts, part).to_numpy(zero_copy_only=False)] = 0
        else:
            put(number, places.having(part.encode()), 0)
    return out


def lists(rows: list[np.ndarray], values: pa.Array, n: int, apart: bool = False) -> pa.Array:
    """For n rows, lists of the values whose ``rows`` name them; ``apart``: of one value for each that they name."""
    owners = np.concatenate([np.zeros(0, np.int64), *rows])
    order = np.argsort(owners, kind="stable")
    which = order if apart else np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int64)[order]
    ends = np.cumsum(np.bincount(owners, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values.take(pa.array(which)))
