"""Removes passages that occur more than once, found exactly after a count-min prefilter.

The sketch doesn't count every window. Each window is charged to its anchor: of the runs of ANCHOR words inside it the
one with the least hash, leftmost of equals. Equal windows have their anchors at equal offsets, so each occurrence of
a window charges an occurrence of its anchor of its own, and the anchor's count is no less than the window's. The
sketch over anchors so overestimates window counts as one over windows would, with a fifteenth of the entries. All
windows whose estimate is two or more go to an exact grouping on 96 bits of hash: none that repeats is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import covered, mix, read, rolling, slices, split_words, word_hashes

WINDOW, ANCHOR = 35, 8
#: The sketch: ROWS_OF_CELLS rows of 2**CELL_BITS cells of one bit in the end (was this cell hit twice?), 16 MiB in
#: all: that is what is broadcast, at any size of input. With more anchors than cells more windows go to the exact
#: grouping, up to all; results stay the same.
ROWS_OF_CELLS, CELL_BITS, SLICE_BITS = 2, 26, 20
#: Windows or anchors that a task holds before it groups and emits them; windows of the input for each range of hashes.
HELD, WINDOWS_PER_BUCKET = 700_000, 3_000_000


#: Runs whose least hash is searched at a time; their places take 24 bits.
RUNS = 1 << 20


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor (which never falls), and the hash of each anchor run."""
    runs = mix(rolling(hashes, anchor), 7)
    span = window - anchor + 1
    found = []
    for at in range(0, len(runs) - span + 1, RUNS):
        part = runs[at : at + RUNS + span - 1]
        # least hash with leftmost position: 40 bits of hash over 24 of position in the part
        least = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        found.append((least & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    return np.concatenate(found), runs


def _cells(keys: np.ndarray) -> np.ndarray:
    """The cells of keys: a row of the result for each row of the sketch, as numbers over all rows."""
    shift = np.uint64(64 - CELL_BITS)
    return np.stack([(mix(keys, 100 + r) >> shift).astype(np.int64) + (r << CELL_BITS) for r in range(ROWS_OF_CELLS)])


def _sketch_batches(window: int, anchor: int):
    """Anchor counts of one task: sorted cells and whether each was hit twice, cut into slices."""

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(_cells(np.concatenate(held)).ravel(), return_counts=True)
        cuts = np.flatnonzero(np.diff(cells >> SLICE_BITS)) + 1
        rows = [
            (int(c[0] >> SLICE_BITS), (c & ((1 << SLICE_BITS) - 1)).astype(np.uint32).tobytes(), (n > 1).tobytes(), int(n.sum()))
            for c, n in zip(np.split(cells, cuts), np.split(counts, cuts), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["slice", "cells", "twice", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                hashes = word_hashes(split_words(text))
                if len(hashes) < window:
                    continue
                at, runs = _anchors(hashes, window, anchor)
                held.append(runs[at[np.concatenate([[True], at[1:] != at[:-1]])]])
                size += len(held[-1])
            if size > HELD:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _merge_slice(final: bool):
    """Adds the slices of a group, saturating at two. final: to one bit a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLICE_BITS, np.uint8)
        number, hits = None, 0
        for batch in batches:
            for number, cells, twice, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "cells", "twice", "hits")), strict=True):
                at = np.frombuffer(cells, np.uint32)
                hits += n
                counts[at] = np.minimum(counts[at] + 1 + np.frombuffer(twice, np.bool_), 2)
        if final:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary()), pa.array([hits], pa.int64())], ["slice", "bits", "hits"])
        else:
            at = np.flatnonzero(counts).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([(counts[at] > 1).tobytes()], pa.binary()), pa.array([hits], pa.int64())], ["slice", "cells", "twice", "hits"])

    return run


def _sketch(texts: DataFrame, window: int, anchor: int) -> tuple[np.ndarray, int]:
    """The merged sketch, one bit for each cell, and about how many windows there are; a fixed size for any input."""
    parts = texts.mapInArrow(_sketch_batches(window, anchor), "slice int, cells binary, twice binary, hits long")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = salted.groupBy("slice", "salt").applyInArrow(_merge_slice(False), "slice int, cells binary, twice binary, hits long")
    merged = some.groupBy("slice").applyInArrow(_merge_slice(True), "slice int, bits binary, hits long")
    bits = np.zeros((ROWS_OF_CELLS << CELL_BITS) // 8, np.uint8)
    width = (1 << SLICE_BITS) // 8
    hits = 0
    for row in merged.toLocalIterator():  # at most ROWS_OF_CELLS << (CELL_BITS - SLICE_BITS) rows
        bits[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
        hits += row["hits"]
    return bits, hits // ROWS_OF_CELLS * (window - anchor + 2) // 2


def _estimated_twice(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    cells = _cells(keys)
    return ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)


def _pack(hashes: np.ndarray, checks: np.ndarray, doc: np.ndarray, places: np.ndarray) -> bytes:
    """Windows in order of hash; their columns byte by byte, which compresses what sorted hashes have in common."""
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (hashes, checks, doc, places))


def _unpack(raw: bytes) -> list[np.ndarray]:
    n = len(raw) // 20
    out, at = [], 0
    for kind in (np.uint64, np.uint32, np.uint32, np.uint32):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


#: In place of a text's number: the window is in several texts of the task, none of which waits for an answer.
_SEVERAL = 0xFFFFFFFF


def _candidates(window: int, anchor: int, sketch, buckets: int):
    """Windows estimated repeated, each once a task and packed by range of hash, with the texts that they are from.

    Those found more than once in the task are known to repeat; their places go out at once, in bucket -1.
    """

    def emit(held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[2]) for h in held])
        hashes, checks, places = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        order = np.lexsort((checks, hashes))
        doc, hashes, checks, places = doc[order], hashes[order], checks[order], places[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
        once = new & np.concatenate([new[1:], [True]])
        rows = _places_by_doc(doc[~once], places[~once], [h[0] for h in held], [h[1] for h in held])
        out = np.flatnonzero(new)
        hashes, checks, places, doc = hashes[out], checks[out], places[out], np.where(once[out], doc[out], np.uint32(_SEVERAL))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part, number = doc[lo:hi].copy(), doc[lo:hi] != _SEVERAL
            named, part[number] = np.unique(part[number], return_inverse=True)
            rows.append(
                (int(bucket[lo]), None, None, [held[i][0] for i in named.tolist()], [held[i][1] for i in named.tolist()], _pack(hashes[lo:hi], checks[lo:hi], part, places[lo:hi]))
            )
        yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = sketch.value, [], 0
        for part in slices(batches):
            for key, tag, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = word_hashes(split_words(text))
                if len(hashes) < window:
                    continue
                at, runs = _anchors(hashes, window, anchor)
                new = np.concatenate([[True], at[1:] != at[:-1]])
                flags = _estimated_twice(runs[at[new]], bits)[np.cumsum(new) - 1]
                if flags.any():
                    places = np.flatnonzero(flags)
                    check = (mix(rolling(hashes, window, 1)[places], 5) >> np.uint64(32)).astype(np.uint32)
                    held.append((key, tag, mix(rolling(hashes, window)[places], 3), check, places.astype(np.uint32)))
                    size += len(places)
            if size > HELD:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


_PACKED = "bucket int, row long, tag long, rows array<long>, tags array<long>, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "row", "tag", "rows", "tags", "data"])


def _places_by_doc(doc: np.ndarray, places: np.ndarray, rows: list[int], tags: list[int]) -> list[tuple]:
    """A row of bucket -1 for each text with places: its id, its tag and the places as packed uint32.

    Rows that repeat id and text are one text, so a task answers such a text once, however often it is repeated.
    """
    if not len(doc):
        return []
    texts: dict[tuple[int, int], int] = {}
    doc = np.array([texts.setdefault(x, i) for i, x in enumerate(zip(rows, tags, strict=True))])[doc]
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64))
    doc, places = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
    cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    return [(-1, rows[doc[lo]], tags[doc[lo]], None, None, places[lo:hi].tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _group_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact grouping of one range of hashes: rows of bucket -1 for texts with windows that others have too."""
    rows: list[int] = []
    tags: list[int] = []
    packed = []
    for batch in batches:
        for names, marks, data in zip(*(batch.column(c).to_pylist() for c in ("rows", "tags", "data")), strict=True):
            hashes, checks, doc, places = _unpack(data)
            packed.append((hashes, checks, np.where(doc == _SEVERAL, doc, doc + np.uint32(len(rows))), places))
            rows += names
            tags += marks
    hashes, checks, doc, places = (np.concatenate([p[i] for p in packed]) for i in range(4))
    packed.clear()
    order = np.lexsort((checks, hashes))
    hashes, checks = hashes[order], checks[order]
    same = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    doc = doc[order]
    asks = doc != _SEVERAL
    # a window repeats if a neighbour in order is the same one, from another task
    twice = (np.append(same, False) | np.append(False, same)) & asks
    yield _rows(_places_by_doc(doc[twice], places[order][twice], rows, tags))


def _cut_batches(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            carried = part.num_columns - 2
            for text, places in zip(part.column(carried).to_pylist(), part.column(carried + 1).to_pylist(), strict=True):
                words = split_words(text)
                n = len(words)
                removed = 0
                if places:
                    starts = np.zeros(n, np.bool_)
                    starts[np.concatenate([np.frombuffer(p, np.uint32) for p in places])] = True
                    gone = covered(starts, window, n)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((n, removed, sha256(kept).hexdigest(), kept.decode() if removed else text)[: 4 if with_text else 3])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            names = [*part.schema.names[:carried], *["n_words", "n_removed", "kept_sha256", "text"][: len(cols)]]
            yield pa.RecordBatch.from_arrays([*part.columns[:carried], *cols], names)

    return run


def repeated_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_row, _tag, places): where windows start that also start elsewhere, in packed parts. rows: see tagged()."""
    bits, windows = _sketch(rows.select("text"), window, anchor)
    sketch = rows.sparkSession.sparkContext.broadcast(bits)
    buckets = max(48, windows // WINDOWS_PER_BUCKET)
    found = rows.select("_row", "_tag", "text").mapInArrow(_candidates(window, anchor, sketch, buckets), _PACKED)
    # Each task sends a window once, so a window has as many entries as tasks at most, however many texts share it.
    # The local answers travel in groups of their own, spread by text.
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("row"), F.lit(buckets))).otherwise(F.col("bucket"))
    answers = found.withColumn("bucket", spread.cast("int")).groupBy("bucket").applyInArrow(_answer, _PACKED)
    # A text has an answer from each task that holds it and each bucket that it asks, equal ones once.
    return answers.groupBy(F.col("row").alias("_row"), F.col("tag").alias("_tag")).agg(F.collect_set("data").alias("places"))


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for first in batches:
        if first.num_rows:
            rest = itertools.chain([first], batches)
            yield from rest if first.column(0)[0].as_py() < 0 else _group_bucket(rest)


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", with_text: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, n_words, n_removed, kept_sha256 of every text; with_text adds the text that is left.

    A word goes if a window of `window` words around it also starts anywhere else. Null, empty and wordless texts have
    no words; texts of fewer words than a window lose none; long texts are judged whole. What is left keeps its form if
    nothing goes, else it is its words joined by one space. Repeated rows are texts of their own, so they lose what
    they share; texts under one id, or without one, are told apart by a hash. Windows have no order, so there are no
    ties. An empty table gives an empty result. Columns of docs that aren't in carry are dropped and can't clash.
    """
    rows = tagged(docs, text, carry)
    places = repeated_windows(rows, window)
    names = [f"_c{i}" for i in range(len(carry))]
    cut = rows.join(places, ["_row", "_tag"], "left").select(*names, "text", "places")
    ddl = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, carry, strict=True))
    more = ", text string" if with_text else ""
    made = cut.mapInArrow(_cut_batches(window, with_text), f"{ddl}n_words long, n_removed long, kept_sha256 string{more}")
    return made.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def tagged(docs: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """The columns in carry as _c0.., text, and _row, _tag: an id that is never null, and a check of the text for ids that repeat."""
    body = F.col(text).cast("string")
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        row.alias("_row"),
        F.xxhash64(body).alias("_tag"),
        body.alias("text"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))
