"""Quality rules from repetition: how much of a text lies in n-grams and lines that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, read, repeated, rolling, slices, split_words, word_hashes

#: Of the characters of a text, the most that may lie in repeated n-grams, by n.
MAX_NGRAM_SHARE = {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30}
#: Of the characters of a text, the most that may lie in lines equal to an earlier line.
MAX_LINE_SHARE = 0.30
#: Of the characters of words, the most that may be symbols.
MAX_SYMBOL_SHARE = 0.08
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("ngram_share", pa.float64()), ("line_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def _word_lengths(raw: bytes) -> np.ndarray:
    """Code points of each word."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points[np.flatnonzero(edge == 1)] - points[np.flatnonzero(edge == -1)]


def measure(text: str | None) -> tuple:
    """The columns of SCHEMA for one text; null and empty texts have no words and fail."""
    raw = (text or "").encode()
    words = split_words(text)
    n = len(words)
    lengths = _word_lengths(raw)
    chars = int(lengths.sum())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))

    seen: set[bytes] = set()
    dup_lines, dup_line_chars = 0, 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode()) for w in line.split())
            elif line.strip():
                seen.add(line)

    hashes = word_hashes(words)
    shares, repeat_words, failed = [0.0], 0, False
    for size, most in MAX_NGRAM_SHARE.items():
        twice = repeated(rolling(hashes, size))
        if twice is None:
            break  # no longer n-gram repeats either
        inside = covered(twice, size, n)
        share = float(lengths[inside].sum()) / chars
        shares.append(share)
        failed |= share > most
        if size == 8:
            repeat_words = int(inside.sum())
    base_failed = n < 20 or 100 * repeat_words > 30 * n
    line_share = dup_line_chars / chars if chars else 0.0
    kept = not (base_failed or failed or line_share > MAX_LINE_SHARE or symbols > MAX_SYMBOL_SHARE * chars)
    return n, chars, symbols, dup_lines, repeat_words, max(shares), line_share, base_failed, kept


def _measure_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [measure(t) for t in part.column(part.num_columns - 1).to_pylist()]
            made = [pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
            kept = part.num_columns - (not with_text)
            names = part.schema.names[:kept] + [f.name for f in SCHEMA]
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], *made], names)

    return run


_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ngram_share double, line_share double, base_failed boolean, kept boolean"
)


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but text by default) with the measures of each text and the verdict `kept`.

    One scan, no shuffle; memory holds a few texts at a time. Null, empty and wordless texts: zeros, base_failed. Long
    texts are measured whole. A column of docs that is named like a measure gives way to it. Repeated rows, repeated ids
    and null ids are measured each by itself. A share equal to its limit passes. An empty table gives an empty result.
    """
    new = {f.name for f in SCHEMA}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new and c != text]
    with_text = keep is not None and text in keep
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(text))
    fields = source.schema.fields if with_text else source.schema.fields[:-1]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return source.mapInArrow(_measure_batches(with_text), ddl + _DDL)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), keep=["doc_id"])
