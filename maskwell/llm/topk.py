"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Each dimension of a block of candidates is a list sorted by value; a query reads it from the end that its sign
favours, all lists to one depth, and never looks a candidate up. At any depth a candidate's score lies between what
was read of it plus the worst and plus the best that its unread entries can be: the far end of the list, and the last
value read. Candidates whose upper bound is below the k-th best lower bound are out; a candidate that no list has
shown yet has an upper bound too, so outsiders need no case of their own. Lists are read on, to twice the depth each
time, until at most k candidates are in or the lists end; entries of those that are out are passed over, and what is
left of the lists resolves the final scores of those that are in. Bounds for many queries at once are products of
matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, table

K, EVERY, SCALE = 5, 50, 256
#: Candidates whose lists are sorted together, queries whose bounds are computed together.
BLOCK, QUERIES = 2048, 512
#: Bytes of queries (8 a component) that are broadcast at once; more queries take further passes over the candidates.
WAVE_BYTES = 64 << 20
#: The depth that lists are first read to.
FIRST_DEPTH = 64


class Best:
    """The k best (score, id) of each query so far, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[:k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(n)[:, None], axis=0)
        self.sorted = np.take_along_axis(vectors, order, axis=0)

    def bounds(self, depth: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For queries with a positive and with a negative component: candidates with unread entries at best, at worst."""
        n, v = len(self.ids), self.vectors
        top, bottom = self.rank < depth, self.rank >= n - depth
        high, low = self.sorted[0], self.sorted[-1]
        return (
            (np.where(top, v, self.sorted[depth - 1]), np.where(bottom, v, self.sorted[n - depth])),
            (np.where(top, v, low), np.where(bottom, v, high)),
        )


def search_block(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, best: Best, report: dict[int, list[int]] | None = None) -> None:
    """Merges the best of one block into best. report: depth -> [queries that read on to it, candidates then in]."""
    n, k = len(lists.ids), best.scores.shape[1]
    depths = [n]
    while depths[0] > FIRST_DEPTH:
        depths.insert(0, depths[0] // 2)
    bounds = {d: lists.bounds(d) for d in depths}
    for at in range(0, len(queries), QUERIES):
        rows = np.arange(at, min(at + QUERIES, len(queries)))
        q = queries[rows]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        alive = lists.ids[None, :] != query_ids[rows][:, None]
        for depth in depths:
            columns = np.flatnonzero(alive.any(axis=0))  # entries of all others are passed over
            (up_plus, up_minus), (low_plus, low_minus) = bounds[depth]
            upper = plus @ up_plus[columns].T + minus @ up_minus[columns].T
            lower = np.where(alive[:, columns], plus @ low_plus[columns].T + minus @ low_minus[columns].T, -np.inf)
            kth = _kth(np.concatenate([lower, best.scores[rows]], axis=1), k)
            alive[:, columns] &= upper >= kth[:, None]
            left = alive.sum(axis=1)
            if report is not None:
                seen = report.setdefault(depth, [0, 0])
                seen[0] += len(rows)
                seen[1] += int(left.sum())
            going = left > 0  # a query that no candidate of the block can enter has done with it
            rows, plus, minus, alive = rows[going], plus[going], minus[going], alive[going]
            if not len(rows) or alive.sum(axis=1).max() <= k:
                break
        if not len(rows):
            continue
        # The lists to their end for who is in: lower and upper bounds meet in the score.
        columns = np.flatnonzero(alive.any(axis=0))
        (ends_plus, ends_minus), _ = bounds[n]
        scores = np.where(alive[:, columns], plus @ ends_plus[columns].T + minus @ ends_minus[columns].T, -np.inf)
        ids = lists.ids[columns]
        kth = np.maximum(_kth(scores, k), best.scores[rows, -1])  # the k best and all that tie with the last of them
        for i, row in enumerate(rows):
            keep = np.flatnonzero((scores[i] >= kth[i]) & (scores[i] > -np.inf))
            if len(keep):
                best.add(row, scores[i, keep], ids[keep])


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, the least float where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, -k, axis=1)[:, -k]


def _search(query_ids, query_vectors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = query_ids.value, query_vectors.value
        best = Best(len(ids), k)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                search_block(queries, ids, Lists(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), best)
                held.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                held.append(_arrays(batch.slice(lo, BLOCK), queries.shape[1]))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    flush()
        flush()
        found = best.scores > -np.inf
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, k)[found.ravel()]), pa.array(best.ids[found]), pa.array(best.scores[found].astype(np.int64))],
            ["query_id", "vec_id", "score"],
        )

    return run


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null, empty or hold null, NaN or infinity."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner product for each query, ties to smaller ids.

    Both frames: vec_id long, vector array<long>, neither null (see whole_numbers); a query's own id is no candidate.
    Vectors of another length than a query's, long ones too, aren't compared with it. Rows that repeat a vec_id are
    candidates each, in order of score; of queries that repeat an id the one with the least vector counts. Without
    candidates or queries the result is empty. Other columns are dropped, whatever their names. Scores are exact up to
    2**53. Queries go in waves of bounded size, each broadcast once and done before the next; no pair of rows is
    shuffled, but k rows a query and task.
    """
    spark = candidates.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shapes = {r["d"]: r["n"] for r in queries.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = []
    for width, count in sorted(shapes.items()):
        waves = -(-count * width * 8 // wave_bytes)
        for number in range(waves):
            some = queries.filter((F.size("vector") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == number)).orderBy("vec_id").toArrow()
            if not some.num_rows:
                continue
            ids, vectors = _arrays(some.combine_chunks().to_batches()[0], width)
            shared = [spark.sparkContext.broadcast(x) for x in (ids, vectors)]
            part = candidates.filter(F.size("vector") == width).select("vec_id", "vector").mapInArrow(_search(*shared, k), "query_id long, vec_id long, score long")
            if waves > 1 or len(shapes) > 1:
                part = table(part, "wave")
                for x in shared:
                    x.destroy()
            found.append(part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))
