"""Token counts of whole texts, encoded in overlapping chunks that are spliced at proven boundaries.

Texts are cut into chunks of CHUNK bytes, so memory is bounded by chunks however long a text is; a text that fits into
one needs no splice.

A boundary is proven stable by the vocabulary: no piece has a word mark after another character, so no merge joins a
character with a mark that follows it. Where a space follows anything else, the pieces to its left and to its right
are those of the whole text, whatever lies beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, tokenizer_file

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Bytes of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 4_096, 256
MARK = "▁"


def _whole(raw: bytes, at: int) -> int:
    """at, or the start of the character that it lies in."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Counter:
    """Counts the pieces of texts with one model; a worker loads each model once."""

    _loaded: dict[str, "Counter"] = {}

    def __init__(self, model: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        #: bytes that each piece stands for in a text: a mark for one space, a byte piece for one byte
        self.widths = np.array(
            [1 if self.pieces.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(names)], np.int64
        )
        #: a space can't merge to its left, and the mark that the model puts before a text stands for a dropped space
        self.splits = not any(MARK in p.lstrip(MARK) for p in names) and self._plain_marks()

    def _plain_marks(self) -> bool:
        """The model keeps each space as a mark, puts one mark first, and changes nothing else."""
        probe = "a  b c"
        return "".join(self.pieces.encode(probe, out_type=str)) == MARK + probe.replace(" ", MARK)

    @classmethod
    def of(cls, model: str) -> "Counter":
        if model not in cls._loaded:
            cls._loaded[model] = cls(model)
        return cls._loaded[model]

    def boundaries(self, raw: bytes, start: int, end: int) -> np.ndarray:
        """Where the pieces of raw[start:end] begin, as offsets in raw, in order.

        Offsets are running sums of the widths of the pieces, after the mark that is put first. They are right if they
        end with the chunk: a character that a piece spells otherwise (the mark itself, in a text) makes the sum less,
        and nothing makes it more. Where they don't, the library gives the offsets.
        """
        chunk = raw[start:end].decode()
        widths = self.widths[np.array(self.pieces.encode(chunk), np.int64)]
        ends = np.cumsum(widths) - 1
        if ends.size and ends[-1] == end - start:
            return start + np.maximum(ends - widths, 0)
        return start + np.array([p.begin for p in self.pieces.encode(chunk, return_type="proto").pieces], np.int64)

    def count_chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """As len(encode(text)): each chunk adds its pieces from the last splice to the next."""
        raw = text.encode()
        size = len(raw)
        total, at, end = 0, 0, _whole(raw, min(chunk, size))
        left = self.boundaries(raw, 0, end)
        while end < size:
            width = overlap
            while True:
                begin, stop = _whole(raw, max(0, end - width)), _whole(raw, min(size, end + chunk))
                right = self.boundaries(raw, begin, stop)
                splice = self._common(raw, left, right, max(begin, at), end)
                if splice is not None or begin <= at:
                    break
                width *= 4  # no common boundary: the next chunk reaches further back
            if splice is None:  # none since the last splice: encode what follows it as one, twice as much each time
                stop = _whole(raw, min(size, end + max(chunk, end - at)))
                left, end = self.boundaries(raw, at + (at > 0), stop), stop
                continue
            total += int(np.searchsorted(left, splice) - np.searchsorted(left, at))
            at, end, left = splice, stop, right
        return total + int(left.size - np.searchsorted(left, at))

    def _common(self, raw: bytes, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """The last offset in (low, high) where pieces of both chunks begin and that is proven stable."""
        near = (x[np.searchsorted(x, low, "right") : np.searchsorted(x, high)] for x in (left, right))
        for x in np.intersect1d(*near)[::-1].tolist():
            if raw[x] == 0x20 and raw[x - 1] != 0x20 and raw[x - 3 : x] != MARK.encode():
                return x
        return None

    def count(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """The pieces of each text. A model that proves no boundary has one chunk a text, whatever its length."""
        one = [not self.splits or len(t) * 4 <= chunk or len(t.encode()) <= chunk for t in texts]
        counts = [len(x) for x in self.pieces.encode([t if x else "" for t, x in zip(texts, one, strict=True)], num_threads=1)]
        return [n if x else self.count_chunked(t, chunk) for t, x, n in zip(texts, one, counts, strict=True)]


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text.

    One scan, no shuffle. Null texts count as empty: no bytes, no tokens. Long texts count whole, chunk by chunk.
    Repeated rows, repeated ids and null ids are counted each by itself; other columns are dropped, whatever their
    names. An empty table gives an empty result. A count equal to the limit isn't over it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model)
        for part in slices(batches, 64):
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
