"""Byte-level BPE: encodes with a pair occurrence index over all new pieces of a batch, and decodes.

The pieces of many texts lie one after another in one array of symbols. The index maps each rank that some pair of
neighbours has to all positions of that pair. Ranks are taken in ascending order; merging one updates the lists of
the pairs to its left and right. Pieces never touch, so this gives each piece its own lowest-rank-first merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
#: How byte-level BPE of this family parts a text before merges (fixed by the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers, their characters at most, and characters of text that are encoded at a time.
CACHE, LONGEST, CHARS = 250_000, 32, 3_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    _loaded: dict[str, "Bpe"] = {}

    @classmethod
    def of(cls, vocabulary: str) -> "Bpe":
        if vocabulary not in cls._loaded:
            cls._loaded[vocabulary] = cls(vocabulary)
        return cls._loaded[vocabulary]

    def __init__(self, vocabulary: str):
        with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.numbers = list(range(size))  # one object for each id, shared by all results
        self.digits = [str(i) for i in range(size)]
        self.bytes = [b""] * size
        for name, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in name)
        for name, i in special.items():
            self.bytes[i] = name.encode()
        self.special = special
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PIECES)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = np.append(pairs[order], np.iinfo(np.int64).max), np.append(order, -1)
        self.pair_of_rank = pairs
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none (symbols of -1 are ends of pieces)."""
        key = (left << 32) | right
        at = np.searchsorted(self.pairs[:-1], key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], -1)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)  # each piece is followed by an end of -1; one more stands before all
        sym = np.full(int(ends[-1]) + 1, -1, np.int64)
        inside = np.ones(len(sym), np.bool_)
        inside[0] = False
        inside[ends] = False
        sym[inside] = self.of_byte[raw]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            at, ranks = at[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if lo == hi:
                    continue
                r = int(ranks[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[lo:hi])

        add(np.arange(1, len(sym) - 1), self._ranks(sym[1:-1], sym[2:]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists))  # neighbouring merges list the pair between them twice
            a, b = self.pair_of_rank[rank] >> 32, self.pair_of_rank[rank] & 0xFFFFFFFF
            right = after[at]
            live = (sym[at] == a) & (sym[right] == b)  # others have been merged meanwhile
            at, right = at[live], right[live]
            if not len(at):
                continue
            if a == b:  # in a run, every second pair from the left
                first = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
                right = after[at]
            sym[at] = self.merged[rank]
            sym[right] = -2
            beyond = after[right]
            after[at], before[beyond] = beyond, at
            prev = before[at]
            add(np.concatenate([prev, at]), np.concatenate([self._ranks(sym[prev], sym[at]), self._ranks(sym[at], sym[beyond])]))
        kept = sym != -2
        sym, count = sym[kept], np.cumsum(kept)
        ids = list(map(self.numbers.__getitem__, np.maximum(sym, 0).tolist()))
        stops = (count[ends] - 1).tolist()
        starts = [1, *(s + 1 for s in stops[:-1])]
        return [tuple(ids[lo:hi]) for lo, hi in zip(starts, stops, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, special strings as their own ids. Long pieces are forgotten after the call."""
        parted, new = [], {}
        for text in texts:
            parts = self.parts.split(text) if self.parts and "<" in text else [text]
            found = [[p] if p in self.special else self.pieces.findall(p) for p in parts if p]
            found = found[0] if len(found) == 1 else list(chain.from_iterable(found))
            parted.append(found)
            new.update((p, None) for p in found if p not in self.known)
        if len(self.known) + len(new) > CACHE:
            new.update((p, None) for found in parted for p in found)
            self.known.clear()
        fresh = [p for p in new if p not in self.special]
        self.known.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        self.known.update((p, (i,)) for p, i in self.special.items())
        for found in parted:
            yield list(chain.from_iterable(map(self.known.__getitem__, found)))
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids joined by commas and of the decoded text; with_ids adds ids, decoded.

    One scan, no shuffle; the index covers some megabytes of text at a time. Null texts are empty: no ids, and the
    digests of nothing. Texts of any length are encoded whole; one longer than CHARS has an index of its own. Repeated
    rows, repeated ids and null ids are encoded each by itself. An empty table gives an empty result. Other columns of
    docs are dropped, whatever their names. Of pairs of one rank the leftmost is merged first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(vocabulary)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + CHARS)))
                part, at = batch.slice(at, to - at), to
                columns: list[list] = [[], [], [], [], []]
                for ids in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    decoded = bpe.decode(ids)
                    made = (len(ids), sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
                    for column, x in zip(columns, (*made, ids, decoded) if with_ids else made, strict=False):
                        column.append(x)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if with_ids else 3]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds) + 1]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"))
