"""Sharding by balanced label propagation: documents with equal texts gather in one shard, shards stay even.

Documents start in the shard that a hash of their id names. Those of one group (equal texts) that start together are
a piece and move together. In each round a group's pieces ask for the shard where most of the group is; a shard admits
the largest gains first while its quota lasts. A group too large for half a shard gathers in several. Rounds go on
until no piece moves: each move goes to where more of the group is, so the sum of squares of the masses rises with
every one and the rounds end. Pieces that no quota admits stay apart. In the end each shard holds its quota of rows
exactly: what linked documents leave free is filled by others in line.
Built of DataFrame operations alone; groups are seen as at most one row a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, read, running, table

SHARDS, SEED = 40, 77
GROUP = ["h", "crc", "size"]
#: Rows of a bucket: ROWS, or more where there would be over BUCKETS of them.
ROWS, BUCKETS = 64, 200_000


def _round(pieces: DataFrame, quota: int, shards: int) -> DataFrame | None:
    """pieces after one round of moves, None if none moves. pieces: GROUP, start, at (its shard now), n (documents)."""
    here = Window.partitionBy(*GROUP, "at")
    seen = pieces.withColumn("mass", F.sum("n").over(here))
    line = Window.partitionBy(*GROUP).orderBy(F.desc("mass"), "at", "start")
    ahead = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("part", F.floor(ahead / max(1, quota // 2)))
    lead = Window.partitionBy(*GROUP, "part").orderBy(F.desc("mass"), "at", "start")
    seen = seen.withColumn("wish", F.first("at").over(lead)).withColumn("gain", F.first("mass").over(lead))
    seen = table(seen, "wishes")

    # One row a shard: what its linked documents hold.
    load = {r["at"]: r["n"] for r in seen.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    free = F.element_at(F.array(*[F.lit(quota - load.get(s, 0)).cast("long") for s in range(shards)]), F.col("wish") + 1)
    asks = seen.filter("wish <> at").withColumn("turn", (64 - F.length(F.bin("gain"))) * 64 + F.pmod("h", F.lit(64)))
    asks = running(table(asks.select(*GROUP, "start", "wish", "gain", "n", "turn"), "asks"), "wish", "turn", [F.desc("gain"), *GROUP, "start"], F.col("n"), "before")
    moves = table(asks.filter(F.col("before") + F.col("n") <= free).select(*GROUP, "start", F.col("wish").alias("to")), "moves")
    if moves.isEmpty():
        drop_tables(seen, moves)
        return None
    moved = seen.join(moves, [*GROUP, "start"], "left").select(*GROUP, "start", F.coalesce("to", "at").alias("at"), "n")
    moved = table(moved, "pieces")
    drop_tables(seen, moves)
    return moved


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is `rows`: the numbers of rows of two shards differ by one at most. slot counts a shard's rows from 0.
    Null texts have no bytes, the checksum of an empty text and no group; empty texts are a group. Long texts count
    whole. Repeated rows are documents of their own and linked, since their texts are equal; null and repeated ids are
    allowed, and rows that tie in a line stand in the order of the input. An empty table gives an empty result. Other
    columns of docs are dropped, whatever their names.
    """
    body = F.col(text).cast("string")
    whole = F.coalesce(body, F.lit(""))
    base = table(
        docs.select(
            "doc_id",
            (F.octet_length(whole) + 16).cast("long").alias("size"),
            F.crc32(whole).alias("crc"),
            F.when(body.isNotNull(), F.xxhash64(body)).alias("h"),
            F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(shards)).cast("int").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "documents",
    )
    total = base.count()
    quota = total // shards
    counts = base.filter("h IS NOT NULL").groupBy(*GROUP, "start").agg(F.count("*").alias("n"))
    pieces = counts.withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP))).filter("all > 1")
    pieces = table(pieces.select(*GROUP, "start", F.col("start").alias("at"), "n"), "pieces")
    while (moved := _round(pieces, quota, shards)) is not None:
        drop_tables(pieces)
        pieces = moved

    # A bucket is a range of hashes of groups; the copies of a large group are dealt over buckets of their own in it.
    per_bucket = max(ROWS, total // BUCKETS)
    buckets = max(1, quota // per_bucket)
    here = pieces.groupBy(*GROUP, "at").agg(F.sum("n").alias("here"))
    placed = base.join(pieces.join(here, [*GROUP, "at"]).select(*GROUP, "start", "at", "here"), [*GROUP, "start"], "left")
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("here") / per_bucket))
    # Linked documents stand in their shard's line group by group, others (shard -1) in a line of their own.
    linked = F.pmod(F.shiftrightunsigned("h", 32), F.lit(buckets)) * BUCKETS * 8 + F.least(salt, F.lit(BUCKETS * 8 - 1))
    alone = F.pmod(F.xxhash64("row"), F.lit(max(1, total // per_bucket)))
    placed = placed.select("doc_id", "size", "crc", "row", F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("h", "row").alias("h"), F.when(F.col("at").isNotNull(), linked).otherwise(alone).alias("bucket"))
    placed = table(placed.withColumn("bucket", F.col("bucket").cast("long")), "placed")
    lines = table(running(placed, "at", "bucket", ["h", "row"], F.lit(1), "place"), "lines")

    # shards + 1 numbers: the length of each line.
    held = {r["at"]: r["n"] for r in placed.groupBy("at").agg(F.count("*").alias("n")).collect()}
    most = [quota + (s < total % shards) for s in range(shards)]
    over, free, waiting = [], [], held.get(-1, 0)
    for s in range(shards):  # rows beyond a quota wait behind the unlinked ones; where free places of a shard begin
        over.append(waiting - most[s])
        waiting += max(0, held.get(s, 0) - most[s])
    filled = [min(held.get(s, 0), most[s]) for s in range(shards)]
    for s in range(shards):
        free.append((free[-1] if free else 0) + most[s] - filled[s])

    def pick(numbers: list[int], at: F.Column) -> F.Column:
        return F.element_at(F.array(*[F.lit(x).cast("long") for x in numbers]), (at + 1).cast("int"))

    linked = F.col("at") >= 0
    stays = linked & (F.col("place") < pick(most, F.greatest("at", F.lit(0))))
    turn = F.when(linked, F.col("place") + pick(over, F.greatest("at", F.lit(0)))).otherwise(F.col("place"))
    begins = [0, *free[:-1]]
    other = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in free]), lambda x: x <= F.col("turn")))
    shard = F.when(stays, F.col("at")).otherwise(other)
    slot = F.when(stays, F.col("place")).otherwise(
        pick(filled, F.least(other, F.lit(shards - 1))) + F.col("turn") - pick(begins, F.least(other, F.lit(shards - 1)))
    )
    return lines.withColumn("turn", turn).select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
