"""Mixing sources to target weights by Pareto order sampling.

Each document expects a number of copies. The whole part is certain; for the rest documents are ranked by the odds of
a random number over the odds of their inclusion, and the first ones make a sample of fixed size, measured in words;
those that don't fit in what is left are skipped.
Expected copies rise a little with a document's length class, so inclusion is unequal within a source too.
Built of DataFrame operations alone: passes over skinny rows, no task holds a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, checked_broadcast, read, running, table, uniform

#: Sources in order take these weights, again and again; no document is taken more often than REPEATS times.
WEIGHTS, REPEATS = (5.0, 2.0, 1.0), 3
#: Expected copies grow by this share for each doubling of a document's length, before targets are met.
LENGTH_SLOPE = 0.05
#: Targets are floating-point numbers; a document fits if it goes beyond what is left by no more than their rounding.
ROUNDING = 1e-6


def water_fill(groups: DataFrame, by: list[str], cap: str, weight: str, total: str, out: str) -> DataFrame:
    """Shares total by weight within each group, no row above its cap; the excess of capped rows is shared again.

    Capped rows are those with the least cap for their weight, so a running sum in that order finds the level.
    """
    ratio = F.col(cap) / F.col(weight)
    up = Window.partitionBy(*by).orderBy("_ratio", F.col(cap)).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy("_ratio", F.col(cap)).rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(*by)
    left = F.col(total) - F.coalesce(F.sum(cap).over(up), F.lit(0.0))
    found = groups.withColumn("_ratio", ratio).withColumn("_level", left / F.sum(weight).over(down))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(all_rows)
    return found.withColumn(out, F.least(F.col(cap), F.coalesce(level * F.col(weight), F.col(cap)))).drop("_ratio", "_level")


def _log_odds(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def _fill(docs: DataFrame, gaps: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row, _in) of the rows of docs (sk, size, row, bucket, left) that fit in their source's gap, and what is left of gaps.

    Rows are taken in order, those that don't fit are skipped, each row up to `left` times. A round takes what comes
    before the first row that doesn't fit, by running sums; after it the gap is smaller than that row. It ends when no
    row that is left fits in its gap: every row has been considered, and each round takes one of each open source.
    """
    rounds = [docs.select("row", F.lit(0).cast("long").alias("_in")).limit(0)]
    while True:
        fits = docs.join(checked_broadcast(gaps), "sk").filter((F.col("left") > 0) & (F.col("size") <= F.col("gap") + ROUNDING))
        at = running(fits, "sk", "bucket", order, F.col("size"), "before")
        at = table(at.withColumn("in", (F.col("before") + F.col("size") <= F.col("gap") + ROUNDING).cast("int")), "before")
        if at.isEmpty():
            return table(reduce(DataFrame.unionByName, rounds).groupBy("row").agg(F.sum("_in").alias("_in")), "filled"), gaps
        took = at.filter("in = 1")
        rounds.append(took.select("row", F.lit(1).cast("long").alias("_in")))
        sums = took.groupBy("sk").agg(F.sum("size").alias("_sum"))
        gaps = table(gaps.join(sums, "sk", "left").select("sk", (F.col("gap") - F.coalesce("_sum", F.lit(0))).alias("gap")), "gaps")
        docs = at.withColumn("left", F.col("left") - F.col("in")).drop("gap", "before", "in")


def mix_sources(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = REPEATS,
    share: float = 1.0,
    seed: int = 20_240_501,
    key: str = "doc_id",
    source: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """key, source, the columns in carry, size, source_size, target, copies and taken (words) of every row of docs.

    Sources in code point order, null last, weigh `weights` repeating and share `share` of all sizes; a target stops
    at `repeats` times its source's size and the excess is shared again. Null, empty and wordless texts take part with
    no words; long texts count whole. Repeated rows are documents of their own: rows that repeat a key and a size draw
    one random number and are told apart by their place in the input; rows without a key draw by that place. Equal
    ranks go by size, key and place. An empty table gives an empty result. Columns of docs that aren't named are
    dropped and can't clash with those made here. The same rows, seed and weights give the same mix.
    """
    # A column of its own for each use: names of docs can't clash with those made here.
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("~"))  # null last: "~" > "s..."
    words = size.cast("long")
    base = table(
        docs.select(
            *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
            F.col(key).alias("_key"),
            F.col(source).alias("_source"),
            named.alias("sk"),
            words.alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
        .withColumn("u", F.when(F.col("_key").isNull(), uniform(F.col("row"), seed + 1)).otherwise(uniform(F.hash("_key", "size"), seed, F.col("_key"))))
        .withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size")).cast("int")).otherwise(-1)),
        "sizes",
    )
    classes = base.groupBy("sk", "class").agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("class_size"))
    classes = table(classes, "classes")
    n_rows = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # Targets of sources: one row a source, a number that doesn't grow with documents.
    sources = classes.groupBy("sk").agg(F.sum("class_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("sk")) - 1
    which = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = (
        sources.withColumn("weight", which)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * share)
    )
    sources = water_fill(sources, [], "cap", "weight", "total", "target").select("sk", "source_size", "target")

    # Copies that documents of a length class expect, so that the source meets its target in expectation.
    some = classes.filter("class >= 0").join(sources, "sk")
    some = some.withColumn("class_cap", F.col("class_size") * repeats).withColumn("class_weight", F.col("class_size") * (1 + LENGTH_SLOPE * F.col("class")))
    some = water_fill(some, ["sk"], "class_cap", "class_weight", "target", "class_target")
    expected = F.col("class_target") / F.col("class_size")
    some = some.withColumn("whole", F.floor(expected + 1e-9)).withColumn("part", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    some = some.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("sk")))
    open_part = (F.col("part") > 1e-9) & (F.col("part") < 1)
    some = some.withColumn("pull", F.when(open_part, _log_odds(F.col("part"))))
    # how the ranks of a source are distributed: one logistic curve for each of its length classes, a few dozen at most
    curves = F.collect_list(F.when(open_part, F.struct("n", "pull"))).over(Window.partitionBy("sk"))
    plan = table(some.withColumn("curves", curves).select("sk", "class", "whole", "pull", "rest", "curves"), "plan")
    plan_rows = plan.count()

    # Pareto order: the odds of the random number over those of inclusion, here as logarithms.
    rank = _log_odds(F.col("u")) - F.col("pull")
    below = F.aggregate("curves", F.lit(0.0), lambda s, c: s + c["n"] / (1 + F.exp(-F.col("rank") - c["pull"])))
    among = F.aggregate("curves", F.lit(0.0), lambda s, c: s + c["n"])
    buckets = bucket_count(n_rows)
    ranked = base.drop(*[f"_c{i}" for i in range(len(carry))]).join(checked_broadcast(plan, plan_rows), ["sk", "class"], "left").withColumn("rank", rank)
    # a bucket is a range of ranks with as many documents as any other of its source
    ranked = table(ranked.withColumn("bucket", F.when(F.col("rank").isNotNull(), F.floor(below / among * buckets)).cast("int")).drop("curves"), "ranked")
    gaps = table(plan.groupBy("sk").agg(F.first("rest").alias("gap")), "gaps")
    columns = ["sk", "size", "row", "_key", "bucket", "left"]
    eligible = ranked.filter("rank IS NOT NULL").withColumn("left", F.lit(1)).select(*columns, "rank")
    first, gaps = _fill(eligible, gaps, ["rank", "size", "_key", "row"])

    # No document that is out fits now. What is left of each target goes to documents that the mix may repeat once more.
    near = ranked.filter("class >= 0").join(checked_broadcast(gaps), "sk").filter(F.col("size") < 2 * F.col("gap")).drop("gap")
    used = near.join(first, "row", "left").withColumn("left", (repeats - F.col("whole") - F.coalesce("_in", F.lit(0))).cast("int"))
    some = table(used.withColumn("bucket", F.floor(F.col("u") * buckets).cast("int")).select(*columns, "u"), "near")
    second, gaps = _fill(some, gaps, ["u", "size", "_key", "row"])
    # One more, if going beyond the target by it comes nearer than stopping short.
    after = some.join(second, "row", "left").filter(F.col("left") > F.coalesce("_in", F.lit(0)))
    beyond = after.join(checked_broadcast(gaps), "sk").filter(F.col("size") < 2 * F.col("gap"))
    nearest = beyond.groupBy("sk").agg(F.min(F.struct("size", "u", "_key", "row")).alias("m")).select(F.col("m.row").alias("row"), F.lit(1).cast("long").alias("_in"))
    chosen = first.unionByName(second).unionByName(nearest).groupBy("row").agg(F.sum("_in").alias("_in"))
    # sources: as many rows as there are sources
    out = ranked.join(chosen, "row", "left").join(checked_broadcast(table(sources, "sources")), "sk")
    if carry:  # long columns are read again at the end
        out = out.join(base.select("row", *[f"_c{i}" for i in range(len(carry))]), "row")
    copies = F.coalesce("whole", F.lit(0)) + F.coalesce("_in", F.lit(0))
    return out.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def word_count(text: str = "text") -> Column:
    """Words of a text, null: 0. Words become one letter each, so that their number is what is left of the length."""
    marked = F.regexp_replace(F.regexp_replace(F.col(text).cast("string"), WORD, "w"), "[^w]", "")
    return F.coalesce(F.length(marked), F.lit(0)).cast("long")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"), word_count())
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
