"""Operator 9: token counts by overlap resynchronisation.

A text of up to ``size`` characters is encoded at once. A longer one is encoded in chunks of ``size`` characters that
overlap; both encodings give token offsets, and the chunks are spliced at an offset in the overlap where both have a
boundary that is proven stable. The proof: BPE merges only build pieces of the vocabulary, so no merge, in any context,
crosses two neighbouring characters that no piece holds side by side; the tokens on either side of such a place do not
depend on the other side. If the overlap has no such offset it is widened, at last to the whole text, so the count is
always that of the whole text. Memory for one text is bound by the chunk unless it has no stable place at all.

Defined results: a null or empty text has 0 bytes and 0 tokens. Rows are independent; all columns of the input are kept,
whatever their names, but for one that is named like the result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import all_but, map_batches, parts_of, quoted, table

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP, LIMIT = 16_384, 256, 4096
_SPACE = "▁"


class Counter:
    def __init__(self, path: str, size: int, overlap: int):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.pieces, self.size, self.overlap = sentencepiece.SentencePieceProcessor(model_file=path), size, min(overlap, size // 2)
        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        norm = model.normalizer_spec
        #: Offsets of text and of normalised text agree only where normalisation changes no character.
        self.plain = model.trainer_spec.model_type == pb.TrainerSpec.BPE and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        self.joined = {p.piece[i : i + 2] for p in model.pieces for i in range(len(p.piece) - 1)}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", _SPACE) not in self.joined

    def ends(self, text: str, start: int, stop: int) -> np.ndarray:
        """The end offset in ``text`` of each token of text[start:stop]. Byte pieces of one character share its end."""
        return start + np.array([end for _, end in self.pieces.encode(text[start:stop], return_type="offset_mapping")["offsets"]], np.int64)

    def long(self, text: str) -> int:
        n, counted, done, start = len(text), 0, -1, 0  # tokens up to offset ``done`` are counted; a lone space mark before the text ends at 0
        stop = min(n, self.size)
        left = self.ends(text, start, stop)
        while stop < n:
            overlap, splice = self.overlap, None
            while splice is None and stop - overlap > done:
                begin, end = stop - overlap, min(n, stop - overlap + self.size + overlap)
                right = self.ends(text, begin, end)
                shared = np.intersect1d(left, right)
                shared = shared[(shared > max(begin, done)) & (shared < stop)]
                splice = next((int(s) for s in shared[::-1] if self.stable(text, s)), None)
                overlap *= 2
            if splice is None:  # no stable place since ``done``: encode on, from the same start
                stop = min(n, stop + 2 * (stop - start))
                left = self.ends(text, start, stop)
                continue
            counted += int(((left > done) & (left <= splice)).sum())
            done, start, stop, left = splice, begin, end, right
        return counted + int((left > done).sum())

    def __call__(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.size or not self.plain]
        out = {
            i: len(x) for i,
            x in zip(short, self.pieces.encode([texts[i] for i in short], num_threads=1, return_type="numpy") if short else ())
        }
        return [out[i] if i in out else self.long(t) for i, t in enumerate(texts)]


@cache
def _counter(path: str, size: int, overlap: int) -> Counter:
    return Counter(path, size, overlap)


def count_tokens(
    df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``df`` with ``n_tokens`` (long) instead of ``text``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    keep = all_but(df, text, n_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        counter = _counter(path, size, overlap)
        for part in (part for batch in batches for part in parts_of(batch, len(keep))):  # sentencepiece holds the ids of one call at a time
            counts = counter([x or "" for x in part.column(len(keep)).to_pylist()])
            yield [*part.columns[: len(keep)], pa.array(counts, pa.int64())]

    return map_batches(df.select(*map(quoted, keep), quoted(text)), keep, run, **{n_tokens: LongType()})


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
