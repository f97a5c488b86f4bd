"""Near-duplicates by SuperMinHash signatures, banding, verification on full shingle sets and union-find.

Each shingle draws one permutation of the signature's places and one value in [j, j + 1) for its j-th place, so the
ranks of one shingle are correlated and signatures vary less than with independent hashes. Values grow with j, so a
document stops as soon as j passes its largest signature value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, drop_tables, mix, read, rolling, slices, table, word_hashes
from .components import components

WORDS, SIMILARITY = 5, 75
#: Signature of PLACES values (a power of two); BANDS of ROWS values each. A pair at 0.75 is missed in all bands with
#: probability (1 - 0.75**4)**32 = 5e-6.
PLACES, BANDS, ROWS = 128, 32, 4
#: Sets of up to so many shingles have exact candidates besides: signatures of very few elements vary more than that.
TINY = 16
#: A pair whose sketches (one byte of each signature value) agree in fewer places is no link: at 0.75 the count has
#: mean 96 and deviation under 5, so 72 lies 5 deviations below.
SKETCH_LEAST = 72
#: Wider sketches of texts that stay unresolved: 384 of 512 with deviation under 10 at 0.75, 340 lies 4.5 below.
WIDE, WIDE_LEAST = 512, 340
#: Groups of candidates up to this size are compared in pairs; of larger ones what is unresolved is regrouped by rare
#: shingles and compared in blocks of at most so many members, of at least so many for up to PARTS blocks.
SMALL, BLOCK, LEAST_BLOCK, PARTS = 8, 1024, 128, 4
#: Shingles that the members of a block have together, on average (4 bytes each).
BLOCK_SHINGLES = 2_000_000
#: Ids of candidates that are broadcast to fetch their texts without a shuffle of all texts.
IDS = 1_000_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    hashes = word_hashes(text.encode().lower().split()) if text else np.empty(0, np.uint64)  # bytes.lower(): A-Z only
    if not len(hashes):
        return hashes
    return np.unique(mix(rolling(hashes, min(words, len(hashes))), min(words, len(hashes))))


def signature(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The SuperMinHash signature: for each place the smallest value, as rank over fraction in uint32.

    The j-th place of an element is ((j * odd + add) & mask) ^ flip, a permutation drawn from its hash of which each
    step can be computed alone.
    """
    mask = np.uint64(places - 1)
    draw = mix(elements, 1)
    odd, add, flip = (draw & mask) | np.uint64(1), (draw >> np.uint64(16)) & mask, (draw >> np.uint64(32)) & mask
    shift = 33 - places.bit_length()  # bits of the fraction
    least = np.full(places, 0xFFFFFFFF, np.uint32)
    most = 0xFFFFFFFF
    for j in range(places):
        if (j << shift) > most:
            break  # no element can lower any value any more
        step = np.uint64(j)
        at = (((step * odd + add) & mask) ^ flip).astype(np.int64)
        value = (mix(elements, j + 2) >> np.uint64(64 - shift)).astype(np.uint32) | np.uint32(j << shift)
        np.minimum.at(least, at, value)
        most = int(least.max())
    return least


def prefix_length(n: int) -> int:
    """Of n shingles in an order that all sets share, how many first ones two sets at the similarity can't all miss."""
    return n + SIMILARITY * -n // 100 + 1


def describe(text: str | None) -> tuple:
    """n_shingles, 128 bits that identify the shingle set, candidate keys, sketch; the last three null without words.

    Keys are the hashes of bands; of tiny sets the first shingles in order of hash too, so that two linked ones share one.
    """
    found = shingles(text)
    if not len(found):
        return 0, None, None, None, None
    whole = [int(np.bitwise_xor.reduce(mix(found, s)) ^ mix(found, s + 1).sum(dtype=np.uint64)) for s in (901, 903)]
    places = signature(found)
    bands = mix(np.add.reduce(mix(places.astype(np.uint64).reshape(BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(1 << 40)), axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    key = np.array(whole, np.uint64).view(np.int64)
    if len(found) <= TINY:
        bands = np.concatenate([bands, mix(found[: prefix_length(len(found))], 905)])
    return len(found), int(key[0]), int(key[1]), bands.view(np.int64), _sketch_of(places)


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    for part in slices(batches):
        rows = [describe(t) for t in part.column(2).to_pylist()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*part.columns[:2], *cols], ["doc_id", "tag", "n_shingles", "k1", "k2", "keys", "sketch"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets reach the similarity; rows of one pivot follow each other, so its set is kept."""
    last, found = None, np.empty(0, np.uint64)
    for part in slices(batches, 128):
        keep = []
        for pivot, text_a, text_b in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if pivot != last:
                last, found = pivot, shingles(text_b)
            mine = shingles(text_a)
            common = len(np.intersect1d(mine, found, assume_unique=True))
            keep.append(100 * common >= SIMILARITY * (len(mine) + len(found) - common))
        kept = part.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])


def _sketch_filter(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) whose sketches agree often enough, and those of two tiny sets."""
    for end in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("rep").alias(end), F.col("sketch").alias(f"s{end}"), F.col("size").alias(f"n{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sides = [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, PLACES) for i in (2, 3)]
            tiny = [part.column(i).to_numpy() <= TINY for i in (4, 5)]
            keep = ((sides[0] == sides[1]).sum(axis=1) >= SKETCH_LEAST) | (tiny[0] & tiny[1])
            yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns[:2], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


class _Search:
    """The representatives (rep, doc_id, tag, size, sketch), and the component of each so far."""

    def __init__(self, reps: DataFrame, docs: DataFrame):
        self.reps, self.docs = reps, docs
        self.labels = table(reps.select("rep", F.col("rep").alias("component")), "labels")

    def texts(self, ids: DataFrame, name: str) -> DataFrame:
        """rep, text of the representatives in ids (rep), one row each, as a table. Ids are broadcast up to IDS."""
        ids = table(ids, f"{name}-ids")
        n = ids.count()
        at = self.reps.select("rep", F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).join(checked_broadcast(ids, n, IDS), "rep", "left_semi")
        at = checked_broadcast(at, n, IDS)
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
        found = table(self.docs.join(at, same).select("rep", "text"), f"{name}-texts")
        again = table(found.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep"), f"{name}-again")
        if not again.isEmpty():  # rows that repeat both id and text
            some = checked_broadcast(again, limit=IDS)
            once = found.join(some, "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
            whole = table(found.join(some, "rep", "left_anti").unionByName(once), f"{name}-texts")
            drop_tables(found)
            found = whole
        drop_tables(ids, again)
        return found

    def links(self, pairs: DataFrame, name: str) -> DataFrame | None:
        """The pairs (a, b) that are links by their full sets, as a table; None if there is nothing to compare."""
        pairs = table(pairs, f"{name}-pairs")
        if pairs.isEmpty():
            drop_tables(pairs)
            return None
        few = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), name)
        with_a = pairs.join(few.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(few.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        links = table(both.select("a", "b", "text_a", "text_b").sortWithinPartitions("b").mapInArrow(_alike, "a long, b long"), f"{name}-links")
        drop_tables(pairs, few)
        return links

    def compare(self, pairs: DataFrame, name: str) -> None:
        """Unites the components of those pairs (a, b) that are links."""
        links = self.links(_sketch_filter(pairs, self.reps), name)
        if links is None:
            return
        if not links.isEmpty():
            ends = links
            for end in ("a", "b"):
                at = self.labels.select(F.col("rep").alias(end), F.col("component").alias(f"c{end}"))
                ends = ends.join(at, end)
            roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            moved = self.labels.join(roots.withColumnRenamed("component", "root"), F.col("component") == F.col("id"), "left")
            labels = table(moved.select("rep", F.coalesce("root", "component").alias("component")), "labels")
            drop_tables(self.labels, roots)
            self.labels = labels
        drop_tables(links)

    def labelled(self, groups: DataFrame) -> DataFrame:
        """groups with the components of each member and of its group's first one."""
        first = self.labels.select(F.col("rep").alias("first"), F.col("component").alias("first_component"))
        return groups.join(self.labels, "rep").join(first, "first")

    def firsts(self, groups: DataFrame) -> None:
        """Compares members of each group (key, rep, first, n, w, size) with its first one.

        First each representative with the first member of one group, then of each group in another component.
        """
        pairs = groups.filter("rep <> first").groupBy(F.col("rep").alias("a")).agg(F.min("first").alias("b"))
        self.compare(pairs, "nearest")
        apart = self.labelled(groups).filter("component <> first_component")
        self.compare(apart.select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), "firsts")

    def rest_in_pairs(self, groups: DataFrame) -> None:
        """Compares those outside the component of their group's first member with all others; for small groups."""
        at = table(self.labelled(groups), "at")
        rest = at.filter("component <> first_component").select("key", F.col("rep").alias("b"), F.col("component").alias("cb"))
        others = at.join(rest, "key").filter("component <> cb and rep <> first")
        self.compare(others.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct(), "rest")
        drop_tables(at)

    def rest_in_blocks(self, groups: DataFrame, sets: DataFrame) -> None:
        """The same for groups of any size: blocks of members meet, and only pairs that may be links come out.

        Groups that overlap are compared as one family where that is less work. Sketches meet first, then wide
        sketches of members that have a partner with a similar sketch, then full sets of those that still have one;
        tiny sets go on without. sets: rep, wide, data (see _short_sets).
        """
        groups = table(groups, "large")
        if groups.isEmpty():
            drop_tables(groups)
            return
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        at = self.labelled(_families(groups)).withColumn("blocks", _block_count(F.col("n"), F.col("w"))).withColumn("own", own)
        at = table(at.withColumn("minor", F.col("component") != F.col("first_component")).withColumn("tiny", F.col("size") <= TINY), "at")
        drop_tables(groups)
        for sketches, least in ((self.reps.select("rep", F.col("sketch").alias("data")), SKETCH_LEAST), (sets.select("rep", F.col("wide").alias("data")), WIDE_LEAST)):
            near = _blocks(at, sketches).applyInArrow(_similar_in_block(least), "key long, rep long").distinct()
            some = table(at.join(table(near, "near"), ["key", "rep"], "left_semi"), "at")
            drop_tables(at)
            at = some
        sets = sets.select("rep", "data")
        self.compare(_blocks(at, sets).applyInArrow(_near_in_block, "a long, b long").distinct(), "blocks")
        drop_tables(at)


def _block_count(n: Column, w: Column) -> Column:
    """Blocks of a group of n members with w shingles in all."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES), F.least(F.ceil(n / LEAST_BLOCK), F.lit(PARTS))).cast("int")


def _families(groups: DataFrame) -> DataFrame:
    """groups (key, rep, first, n, w, size), with those that hang together by common members made one group where that is less.

    A member is in one group for each of its rare shingles, and most of these have nearly the same members, so a family
    is sent and compared once in place of dozens of times. A family keeps its groups if, as one, more members would be
    sent to blocks or more pairs would meet, as in a large one that a few members hold together. A family holds all
    pairs of its groups.
    """
    family = components(groups.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    family = table(family.join(groups.select(F.col("rep").alias("id"), "size").distinct(), "id"), "family")
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    by_key = groups.filter("rep = first").join(family.select("id", "component"), F.col("first") == F.col("id"))
    by_key = by_key.groupBy("component").agg(F.sum(n * _block_count(n, F.col("w"))).alias("sent"), F.sum(n * n).alias("met"))
    sizes = family.groupBy("component").agg(F.count("*").alias("m"), F.sum("size").alias("v"))
    less = by_key.join(sizes, "component").filter((m * _block_count(m, F.col("v")) <= F.col("sent")) & (m * m <= F.col("met")))
    less = checked_broadcast(table(less.select("component", "m", "v"), "families"))
    whole = family.join(less, "component").select(
        F.xxhash64("component").alias("key"), F.col("id").alias("rep"), F.col("component").alias("first"), F.col("m").alias("n"), F.col("v").alias("w"), "size"
    )
    one = checked_broadcast(table(family.join(less, "component", "left_semi").select(F.col("id").alias("rep")), "of-whole"), limit=IDS)
    return whole.unionByName(groups.join(one, "rep", "left_anti").select("key", "rep", "first", "n", "w", "size"))


def _blocks(at: DataFrame, data: DataFrame) -> GroupedData:
    """Blocks (i, j) of each group that has minor members: those of block i (side 0) and all of block j (side 1).

    If i = j a member is sent once (side 2).
    """
    some = checked_broadcast(table(at.filter("minor").select("key").distinct(), "minor"))
    at = at.join(some, "key", "left_semi").join(data, "rep")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    same = ["key", "rep", "component", "minor", "tiny", "data"]
    mine = at.filter("minor AND blocks > 1").select("own", every.alias("j"), F.lit(0).alias("side"), *same).filter("j <> own")
    theirs = at.select("own", every.alias("i"), *same)
    theirs = theirs.select(F.col("i"), F.col("own").alias("j"), F.when(F.col("i") == F.col("own"), 2).otherwise(1).alias("side"), *same)
    return mine.withColumnRenamed("own", "i").unionByName(theirs).groupBy("key", "i", "j")


def _sketch_of(places: np.ndarray) -> bytes:
    """One byte of each signature value."""
    return (mix(places.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def _short_sets(texts: DataFrame) -> DataFrame:
    """rep, wide (a sketch of WIDE places), data (32 bits of each shingle of a text, packed). texts: rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = [shingles(t) for t in part.column(1).to_pylist()]
            wide = [_sketch_of(signature(f, WIDE)) for f in found]
            data = [np.unique((f >> np.uint64(32)).astype(np.uint32)).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(wide, pa.binary()), pa.array(data, pa.binary())], ["rep", "wide", "data"])

    return table(texts.select("rep", "text").mapInArrow(run, "rep long, wide binary, data binary"), "short")


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], int]:
    """Which members ask, which are asked, their ids, components, which are tiny, data, and the key of their group."""
    held = pa.Table.from_batches(list(batches))
    side, rep, component, minor, tiny = (np.array(held.column(c).to_pylist()) for c in ("side", "rep", "component", "minor", "tiny"))
    left, right = np.flatnonzero((side == 0) | ((side == 2) & minor)), np.flatnonzero(side >= 1)
    return left, right, rep, component, tiny, held.column("data").to_pylist(), held.column("key")[0].as_py()


def _similar_in_block(least: int):
    """Members with a partner in another component whose sketch agrees in so many places, or that is tiny as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, rep, component, tiny, data, key = _sides(batches)
        sketches = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        found = np.zeros(len(rep), np.bool_)
        for lo in range(0, len(left), 16):
            some = left[lo : lo + 16]
            near = (sketches[some][:, None, :] == sketches[right][None, :, :]).sum(axis=2) >= least
            near |= tiny[some][:, None] & tiny[right][None, :]
            near &= component[some][:, None] != component[right][None, :]
            found[some[near.any(axis=1)]] = True
            found[right[near.any(axis=0)]] = True
        out = rep[found]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), key, np.int64)), pa.array(out.astype(np.int64))], ["key", "rep"])

    return run


def _near_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in two components whose short sets nearly reach the similarity; counted by products of matrices."""
    left, right, rep, component, _, data, _ = _sides(batches)
    sets = [np.frombuffer(d, np.uint32) for d in data]
    sizes = np.array([len(x) for x in sets])
    words = np.concatenate(sets)
    order = np.argsort(words, kind="stable")
    words, of = words[order], np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    del order
    starts = np.ones(len(words), np.bool_)
    starts[1:] = words[1:] != words[:-1]
    shared = ~(starts & np.append(starts[1:], True))  # words of one member alone add nothing
    of, place = of[shared], np.cumsum(starts[shared], dtype=np.int32) - 1
    del words, starts, shared
    rows = np.full((2, len(sets)), -1)
    rows[0, left], rows[1, right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
        some = slice(*np.searchsorted(place, [lo, lo + 2048]))
        held = []
        for row, size in zip(rows, both.shape, strict=True):
            at = row[of[some]]
            matrix = np.zeros((size, 2048), np.float32)
            matrix[at[at >= 0], place[some][at >= 0] - lo] = 1
            held.append(matrix)
        both += held[0] @ held[1].T
    near = 100 * both >= (SIMILARITY - 1) * (sizes[left][:, None] + sizes[right][None, :] - both)
    near &= component[left][:, None] != component[right][None, :]
    x, y = (rep[side[at]] for side, at in zip((left, right), np.nonzero(near), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def _grouped(members: DataFrame, name: str) -> DataFrame:
    """(key, rep, first, n, w, size) of the keys that several representatives have, as a table: n members, w shingles.

    members: key, rep, size (shingles of the representative).
    """
    shared = members.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n"), F.sum("size").alias("w")).filter("n > 1")
    shared = table(shared, f"{name}-keys")  # so that the join has two shuffles, of which Spark can split a hot one
    groups = table(members.join(checked_broadcast(shared), "key").select("key", "rep", "first", "n", "w", "size"), name)
    drop_tables(shared)
    return groups


def _rare_shingles(texts: DataFrame) -> DataFrame:
    """(key, rep, size): the rarest shingles of each text, so many that two texts at the similarity share one of them.

    Of n shingles the n - ceil(0.75 n) + 1 rarest, in one order for all: by how many of these texts have them, then by
    hash. texts: rep, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = [shingles(t) for t in part.column(1).to_pylist()]
            rep = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
            size = np.repeat([len(f) for f in found], [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)), pa.array(size, pa.int64())], ["rep", "key", "size"]
            )

    every = table(texts.select("rep", "text").mapInArrow(run, "rep long, key long, size long"), "shingles")
    common = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # shingles of one text alone are rarest and group nothing: they only take places of the text's prefix
    known = every.join(table(common, "common"), "key")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("n", "key")) + F.col("size") - F.count("*").over(Window.partitionBy("rep"))
    prefix = F.col("size") - F.ceil(F.col("size") * SIMILARITY / 100) + 1
    return known.withColumn("place", place).filter(F.col("place") <= prefix).select("key", "rep", "size")


def tagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id as long, tag (a hash of the text) and text: an id with a tag names a text even where ids repeat."""
    body = F.col(text).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shingle set of every row, and the component of every class of equal sets, as tables.

    docs: see tagged(). First: doc_id, tag, n_shingles, k1, k2, one row for each of docs. Second: k1, k2, component (a
    number), doc_id (the smallest of the class).
    """
    sets = table(docs.mapInArrow(_describe_batches, "doc_id long, tag long, n_shingles long, k1 long, k2 long, keys array<long>, sketch binary"), "sets")
    some = sets.filter("n_shingles > 0")
    smallest = F.struct(F.isnull("doc_id"), "doc_id", "tag")
    reps = some.groupBy("k1", "k2").agg(F.min_by(F.struct("doc_id", "tag", "keys", "sketch"), smallest).alias("s"), F.first("n_shingles").alias("size"))
    reps = table(reps.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "size", "s.*"), "reps")
    search = _Search(reps, docs)
    # a band's hash has its number mixed in, so it is the key alone
    groups = _grouped(reps.select("rep", F.explode("keys").alias("key"), "size"), "groups")
    search.firsts(groups)
    many = groups.filter("n > 2")
    search.rest_in_pairs(many.filter(F.col("n") <= SMALL))
    many = table(many.filter(F.col("n") > SMALL), "many")
    keys = table(search.labelled(many).filter("component <> first_component").select("key").distinct(), "keys")
    rest = table(many.join(checked_broadcast(keys), "key", "left_semi").select("rep").distinct(), "rest")
    if not rest.isEmpty():
        texts = search.texts(rest, "rest")
        rare = _grouped(_rare_shingles(texts), "rare")
        search.firsts(rare)
        search.rest_in_pairs(rare.filter(F.col("n") > 2).filter(F.col("n") <= SMALL))
        search.rest_in_blocks(rare.filter(F.col("n") > SMALL), _short_sets(texts))
        drop_tables(rare, texts)
    classes = table(reps.join(search.labels, "rep").select("k1", "k2", "component", "doc_id"), "classes")
    rows = table(sets.select("doc_id", "tag", "n_shingles", "k1", "k2"), "rows")
    drop_tables(groups, many, keys, rest, sets, reps, search.labels)
    return rows, classes


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (is it that one).

    Documents with one shingle set are a class, represented by its smallest doc_id. Representatives that share a band,
    or tiny ones that share one of their first shingles in order of hash, are candidates: all are compared with the
    first of their group, then, in small groups, those that aren't in its component with the others. Members of large
    groups that stay unresolved (many texts that are alike, but too little) are regrouped by their rarest shingles, of
    which every two linked texts share one, and are compared in blocks, groups with common members as one family where
    that is less work. So no two candidates in different components stay uncompared, and no group expands into pairs.

    One row for each row of docs. Null, empty and wordless texts: no shingles, linked with nothing. Long texts count
    whole. Rows that repeat a doc_id are judged each by its own text; null ids are linked by their texts too and give
    no component_id: it is null where no row of the component has an id. Repeated rows are equal texts. Ties don't
    matter, as the smallest id names a component. An empty table gives an empty result. Other columns are dropped,
    whatever their names.
    """
    rows, classes = near_classes(tagged(docs, text))
    # only components of several classes are named anew
    several = classes.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("component", "least")
    named = classes.join(checked_broadcast(table(several, "several")), "component", "left")
    named = named.select("k1", "k2", F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.join(named, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
