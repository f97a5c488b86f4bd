"""Measures of privacy and use over scenarios: leaks, coverage, tool accuracy, argument quality, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_share(found: DataFrame) -> DataFrame:
    """type, n, share in percent of all mentions. The window runs over one row a type."""
    counts = found.groupBy("type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def leaks(originals: DataFrame, args: DataFrame) -> DataFrame:
    """scenario, value of originals longer than three characters that an argument value holds. Joined by scenario."""
    pairs = originals.filter(F.length("value") > 3).join(args, "scenario")
    return pairs.filter(F.contains(F.lower("arg"), F.lower("value"))).select("scenario", "value").distinct()


def tool_accuracy(expected: Column, called: Column) -> Column:
    distinct = F.array_distinct(expected)
    return F.when(F.size(distinct) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(distinct, called)) / F.size(distinct))


def args_quality(expected: DataFrame, calls: DataFrame) -> DataFrame:
    """scenario, quality: share of expected fields that the first call of their tool meets, by value or by token.

    expected: scenario, tool, field, value, token_type. calls: scenario, tool, ord, field, arg.
    """
    first = calls.groupBy("scenario", "tool").agg(F.min("ord").alias("ord"))
    got = calls.join(first, ["scenario", "tool", "ord"]).select("scenario", "tool", "field", "arg")
    token = F.regexp_like("arg", F.concat(F.lit("\\[" ), "token_type", F.lit("_\\d+\\]")))
    joined = expected.join(got, ["scenario", "tool", "field"], "left")
    return joined.groupBy("scenario").agg(F.avg(F.coalesce((F.contains("arg", "value") | token).cast("double"), F.lit(0.0))).alias("quality"))


def token_preservation(found: Column, expected: Column) -> Column:
    return F.when(expected == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), found / expected))


def breakdown(facts: DataFrame, by: str = "vertical") -> DataFrame:
    """by, n, accuracy with and without redaction, delta, detected, leaked, leak rate, mean latency (zero: unknown)."""
    mode = lambda m, c: F.avg(F.when(F.col("mode") == m, F.col(c)))
    out = facts.groupBy(by).agg(
        F.count("*").alias("n"), mode("raw", "accuracy").alias("raw_accuracy"), mode("masked", "accuracy").alias("masked_accuracy"), F.sum("detected").alias("detected"),
        F.sum("leaked").alias("leaked"), F.avg(F.nullif("latency", F.lit(0.0))).alias("latency"),
    )
    return out.withColumn("delta", F.col("masked_accuracy") - F.col("raw_accuracy")).withColumn("leak_rate", F.col("leaked") / F.greatest("detected", F.lit(1)))


def totals(facts: DataFrame, dollars_per_token: float = 2e-6) -> DataFrame:
    """mode, errors, tokens and their cost. facts: mode, error (null if none), input_tokens, output_tokens."""
    tokens = F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return facts.groupBy("mode").agg(F.count("error").alias("errors"), tokens.alias("tokens"), (tokens * dollars_per_token).alias("cost"))


def tool_differences(expected: Column, called: Column) -> Column:
    """Struct of the tools that were expected but not called, and the other way round, each once and in order."""
    return F.struct(F.array_sort(F.array_except(expected, called)).alias("missing"), F.array_sort(F.array_except(called, expected)).alias("extra"))


def latency_overhead(raw: Column, masked: Column) -> Column:
    """Percent that masked takes longer than raw; null where raw is zero or unknown."""
    return (masked - raw) * 100.0 / F.nullif(raw, F.lit(0.0))


def ranked_types(found: DataFrame) -> DataFrame:
    """type, n, rank: types by number of mentions, the most frequent first; the window runs over one row a type."""
    counts = found.groupBy("type").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "type")))
