"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, table

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by FOLDS. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> DataFrame:
    """(doc_id, label, text): at most per_class[value] rows of each label value outside the held-out fold, as a table.

    Chosen by a hash of the id, so that the same rows come out each time. This bound is the operator's parameter; it
    bounds the broadcast of ids too. Ids with several labels count with the largest, ids with several texts once each.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    named = named.filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("doc_id")))
    named = table(named.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    some = None
    for value, most in per_class.items():
        part = named.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = table(some, "sample")
    return table(texts.join(checked_broadcast(some, limit=sum(per_class.values())), "doc_id"), "training")
