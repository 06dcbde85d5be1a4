"""Operator 8: byte-level BPE encoding and decoding.

A ``sentencepiece`` BPE model is written directly from a rank file: piece *r* is the token of rank *r* with every byte
mapped to one character, its score is ``-r`` and normalisation is the identity, so the library's merges follow the ranks.
Texts are split by the pre-token pattern and each match is encoded on its own (a match that is itself a token is that
token); decoding maps ids back to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids decode to no bytes. Rows are independent,
so repeated rows and ties do not matter; all columns of the input are kept, whatever their names, but for those named like
a result. An empty table gives an empty result. Memory holds one Arrow batch and a memo of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .common import all_but, map_batches, parts_of, quoted, table

#: Bytes of texts whose new pre-tokens are encoded in one call.
TOGETHER = 1 << 18

#: Pre-tokens kept by each Python worker; the memo is emptied when it is full.
MEMO = 100_000

VOCABULARY = "byte_bpe_50k.tiktoken"

#: The characters for bytes: a visible byte stands for itself, others for a letter beyond Latin-1.
_CHARS = "".join(chr(b if 0x21 <= b <= 0x7E or 0xA1 <= b else 0x100 + b) for b in range(256))

#: A byte that UTF-8 never uses, so it can separate pre-tokens.
_APART = b"\xff"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank. Ranks must be 0, 1, 2, ... and hold every single byte."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    tokens = [ranks[r] for r in range(len(ranks))]
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"{len(missing)} bytes have no token")
    return tokens


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_CHARS)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with these tokens in this order; the piece after the last stands for unknown text."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=as_piece(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = pb.TrainerSpec.BPE, len(model.pieces), len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Encoder:
    """``known`` is a memo from pre-token to its ids, as the bytes of 32-bit integers."""

    def __init__(self, model: bytes, pattern: str, memo: int = MEMO):
        import regex
        import sentencepiece

        self.pieces, self.memo, self.known = sentencepiece.SentencePieceProcessor(model_proto=model), memo, {}
        self.split = regex.compile(pattern).findall
        self.whole = {
            self.pieces.id_to_piece(i): array("i", (i,)).tobytes() for i in range(self.pieces.get_piece_size()) if i != self.pieces.unk_id()
        }

    def learn(self, pretokens: list[str]) -> None:
        pieces = as_piece(_APART.join(map(str.encode, pretokens))).split(as_piece(_APART))
        rest = []
        for p, piece in zip(pretokens, pieces):
            if (one := self.whole.get(piece)) is None:
                rest.append((p, piece))
            else:
                self.known[p] = one
        for (p, _), ids in zip(rest, self.pieces.encode([x for _, x in rest], num_threads=1) if rest else ()):
            self.known[p] = array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if new := set().union(*split).difference(self.known):
            if len(self.known) + len(new) > self.memo:
                self.known.clear()
                new = set().union(*split)
            self.learn(list(new))
        one = self.known.__getitem__
        return [b"".join(map(one, pretokens)) for pretokens in split]


@cache
def _encoder(digest: str, pattern: str, memo: int, model) -> Encoder:
    return Encoder(model.value, pattern, memo)


def _bytes_of(column: pa.ListArray, tokens: pa.BinaryArray) -> pa.Array:
    """The bytes that each row's ids stand for: those of all ids stand one after the other, so rows only need their ends."""
    flat = tokens.take(column.flatten())
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()])
    starts = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset) if len(flat) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(column), [None, pa.py_buffer(starts[ends].tobytes()), flat.buffers()[2] or pa.py_buffer(b"")]
    )


@cache
def _token_array(digest: str, tokens) -> pa.BinaryArray:
    return pa.array(tokens.value, pa.binary())


def _held_tokens(spark: SparkSession, path: str | None):
    """The vocabulary on the executors (bounded by its file), as a function to call there."""
    tokens = read_ranks(path or vocabulary_path())
    digest, held = hashlib.sha256(b"\0".join(tokens)).hexdigest(), spark.sparkContext.broadcast(tokens)
    return lambda: _token_array(digest, held)


def encode(
    df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, decoded: str | None = None
) -> DataFrame:
    """``df`` with column ``ids`` (array of int) instead of ``text``; with ``decoded``, also as decode() in the same worker."""
    import public_tokenizers

    pattern, spark = pattern or public_tokenizers.PATTERN, df.sparkSession
    model = serialise_model(read_ranks(path or vocabulary_path()))
    digest, held = hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model)  # bounded by the vocabulary file
    keep = all_but(df, text, ids, decoded or ids)
    tokens = _held_tokens(spark, path) if decoded else None
    more = {decoded: BinaryType()} if decoded else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder = _encoder(digest, pattern, MEMO, held)
        for part in (part for batch in batches for part in parts_of(batch, len(keep), TOGETHER)):
            coded = encoder.encode([x or "" for x in part.column(len(keep)).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            back = [_bytes_of(column, tokens())] if tokens else []
            yield [*part.columns[: len(keep)], column, *back]

    return map_batches(df.select(*map(quoted, keep), quoted(text)), keep, run, **{ids: ArrayType(IntegerType())}, **more)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` and column ``decoded`` (binary), the bytes that ``ids`` stand for. An id outside the vocabulary is an error."""
    tokens = _held_tokens(df.sparkSession, path)
    keep = all_but(df, decoded)
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            yield [*batch.columns, _bytes_of(batch.column(at), tokens())]

    return map_batches(df.select(*map(quoted, keep)), keep, run, **{decoded: BinaryType()})


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes of what encode() and decode() return."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded"))
