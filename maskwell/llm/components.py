"""Connected components of a graph given as pairs of ids: union-find inside partitions, then rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, table


class UnionFind:
    """Sets of ids, each with its smallest member as root; paths are halved on the way."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's pairs as (member, root): no more rows than ids, whatever the number of pairs."""
    sets, limit = UnionFind(), 500_000

    def rows() -> pa.RecordBatch:
        found = [(x, r) for x in list(sets.parent) if (r := sets.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > limit:  # bounded memory: what is united so far stays united below
            yield rows()
            sets = UnionFind()
    yield rows()


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every id in pairs (a, b): component is the smallest id that can be reached.

    Each round sends every root to its smallest neighbouring root and contracts the pairs that are left. Labels only
    fall, and both ends of a contracted pair follow the same steps, so they agree when no pair is left.
    """
    edges = table(pairs.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = table(ids.withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("_at")).agg(F.min("b").alias("_to")).filter("_to < _at")
        parent = table(parent, "parent")
        moved = table(
            labels.join(parent, F.col("component") == F.col("_at"), "left").select(
                "id", F.coalesce("_to", "component").alias("component")
            ),
            "labels",
        )
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(parent, F.col(end) == F.col("_at"), "left").withColumn(end, F.coalesce("_to", end)).drop("_at", "_to")
        left = table(
            ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
        )
        drop_tables(edges, labels, parent)
        edges, labels = left, moved
    drop_tables(edges)
    return labels
