"""Shared pieces of the training-data operators: tables, words, rolling hashes, running totals."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A side of a join is broadcast up to so many rows (skinny rows: under 100 bytes each).
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch on its way to and from Python: a task holds a few, in the JVM and in its worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by bytes, as rows of long texts make thousands of rows large; results don't change."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; on a cluster that is an error, as each executor would
    write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="maskwell-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_OWN: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """The application's folder for tables, under the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/maskwell/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        small_batches(spark)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _OWN.add(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, gives the planner sizes."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Removes tables made by table() once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/maskwell/" in path.toString():
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows (counted, or given), else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def uniform(key: Column, seed: int, *more: Column) -> Column:
    """A number in (0, 1) that depends on key, seed and more columns alone."""
    bits = F.xxhash64(key, F.lit(seed), *more).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    return max(1024, rows // per_bucket)


def running(df: DataFrame, key: str, bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the total of value over the rows of the same key that come before a row, by bucket and then order.

    No task holds a whole key: buckets are summed first (map-side), their totals are accumulated, and rows are
    ordered only within (key, bucket). df is read twice, so it should be a table().
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [key, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_offset")
    )


# ---------------------------------------------------------------------------- numpy on one text


class WordHash(dict):
    """word bytes -> 64-bit hash, kept for the short words seen most recently: at most LIMIT of LONGEST bytes."""

    LIMIT, LONGEST = 150_000, 48

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() parts at exactly the six ASCII white space characters."""
    return text.encode().split() if text else []


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))]), dtype=np.uint64)
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_BASES = (_Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of every run of n consecutive values."""
    size = len(hashes)
    if size < n:
        return np.empty(0, np.uint64)
    up, down = _BASES[which].get(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return (sums[n:] - sums[:-n]) * down[: size - n + 1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(values: np.ndarray) -> np.ndarray | None:
    """A mask of the values that occur twice or more, None if there are none."""
    order = np.sort(values)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(values, twice) if len(twice) else None


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """A mask over size words of those inside a window of width words that a true value of starts begins."""
    steps = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    steps[at] += 1
    np.subtract.at(steps, at + width, 1)
    return np.cumsum(steps[:-1]) > 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that Python objects exist for few texts at a time.

    Workers live on between tasks: what Arrow holds of the batches is given back after the last one.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file: a path as given, or a name that the tokenizer package knows."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
