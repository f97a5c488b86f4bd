"""Texts and conversations from files, results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, form: str = "parquet", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, text of a parquet, orc, json, csv or text source; only these columns are read."""
    df = spark.read.format(form).options(**options).load(path)
    if form == "text":
        return df.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def read_labels(spark: SparkSession, path: str) -> dict[int, str]:
    """Tag names of a recogniser by number, from a JSON file with id2label; as many rows as tags."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.id2label"), "map<string,string>")))
    return {int(r["key"]): r["value"] for r in rows.collect()}


def write_results(results: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Sanitized texts and token maps; CSV has no nested columns, so maps are JSON there."""
    if form == "csv":
        results = results.withColumn("token_map", F.to_json("token_map"))
    results.write.mode(mode).format(form).save(path)


def token_rows(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token maps as rows."""
    return results.select(key, F.inline("token_map"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes in fewer parts than there are: for expensive work on small inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
