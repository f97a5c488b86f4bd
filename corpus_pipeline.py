"""From raw documents to token ids: quality, near-duplicates, repeated passages, source weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.bpe import bpe_round_trip
from maskwell.llm.common import checked_broadcast, small_batches, table
from maskwell.llm.minhash import IDS, near_classes, tagged
from maskwell.llm.mixing import mix_sources, word_count
from maskwell.llm.quality_rules import quality_rules
from maskwell.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and wordless texts fail and go, as do texts of fewer than 20 words. Each row is judged by its own text,
    whatever its id, and long texts whole; repeated rows fare alike. An empty table gives an empty result, and columns
    beyond those of documents are dropped.
    """
    small_batches(spark)
    return quality_rules(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    A document is an id with a text: texts under one id are judged each for itself, and a null id comes last and is no
    id that rows share. Rows that repeat both id and text are one document and leave one row; so do null ids with one
    text that has words. Null, empty and wordless texts are linked with nothing: all rows with a null id and no words
    stay. Long texts count whole; ties go to the smaller hash of the text. An empty table gives an empty result.
    """
    named = docs.select(*COLUMNS)
    rows, classes = near_classes(tagged(named))
    found = rows.join(classes.select("k1", "k2", "component"), ["k1", "k2"], "left")
    found = found.groupBy("doc_id", "tag").agg(F.first("component").alias("component"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    found = table(found, "near")
    order = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "tag")
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("of")).filter("of > 1")
    gone = found.join(checked_broadcast(table(best, "best")), "component").filter(order != F.col("best"))
    again = found.filter("n > 1 AND (doc_id IS NOT NULL OR n_shingles > 0)")
    gone, again = (table(x.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")), "pairs") for x in (gone, again))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tag"))
    rest = named.join(checked_broadcast(gone, limit=IDS), same, "left_anti")
    if not again.isEmpty():  # only the texts of repeated rows are shuffled
        again = checked_broadcast(again, limit=IDS)
        once = rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        rest = rest.join(again, same, "left_anti").unionByName(once)
    return rest.select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; n_chars follows the text of those that lose words.

    No row goes: a text of which all words go is empty after it. Null and empty texts stay as they are, and so do texts
    of fewer words than a window. Rows that repeat a text lose all that they share; null and repeated ids are told
    apart by their texts. An empty table gives an empty result, and other columns are dropped.
    """
    cut = substring_dedup(docs, with_text=True, carry=("doc_id", "lang", "source", "n_chars"))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.withColumn("n_chars", changed).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by words and source weights.

    Null, empty and wordless texts are taken no time and go. Null sources are a source, the last one; null ids and
    repeated rows are documents of their own. An empty table gives an empty result, and other columns are dropped.
    """
    mixed = mix_sources(docs, word_count(), carry=("text", "lang", "n_chars"))
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and digests of the ids and of what they decode to: one row a document.

    Null and empty texts have no ids. Repeated rows, which the mix makes, are encoded each. An empty table gives an
    empty result.
    """
    small_batches(spark)
    return bpe_round_trip(docs, with_ids=True).drop("decoded")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", drop_passages),
    ("mixing", mix),
    ("bpe", encode),
]

#: Random ranks and merges have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
