"""Conversations: one numbering of values for all turns of a session, tool calls, and text that comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RULES, Rule
from ..functions.text import apply_token_map, rehydrate
from .mentions import mentions


def session_mentions(turns: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """conv_id, turn and the mentions of each turn."""
    keyed = turns.withColumn("_at", F.struct("conv_id", "turn"))
    return mentions(keyed, "_at", "text", rules).withColumns({"conv_id": F.col("_at.conv_id"), "turn": F.col("_at.turn")}).drop("_at")


def session_tokens(turns: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """conv_id, type, original_value, token: numbers by first appearance; the same value has one token in all turns.

    First appearances are taken before numbering, so a session with many turns is numbered over its distinct values.
    """
    found = session_mentions(turns, rules)
    first = found.groupBy("conv_id", F.col("core").alias("original_value")).agg(F.min(F.struct("turn", "rule_seq", "ord", "type")).alias("at"))
    order = Window.partitionBy("conv_id", "at.type").orderBy("at.turn", "at.rule_seq", "at.ord", "original_value")
    n = F.row_number().over(order)
    return first.select("conv_id", F.col("at.type").alias("type"), "original_value", n.alias("n"), F.concat(F.lit("["), F.col("at.type"), F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))


def session_maps(tokens: DataFrame) -> DataFrame:
    """conv_id, token_map of each session."""
    return tokens.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("token", "type", "original_value"))).alias("token_map"))


def redact_session(turns: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """conv_id, turn, role, sanitized: every known value of the session as its token, longest first."""
    maps = session_maps(session_tokens(turns, rules))
    joined = turns.join(maps, "conv_id", "left")
    body = F.coalesce("text", F.lit(""))
    return joined.select("conv_id", "turn", "role", F.when(F.col("token_map").isNull(), body).otherwise(apply_token_map(body, F.col("token_map"))).alias("sanitized"))


def redact_tool_output(outputs: DataFrame, tokens: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """conv_id, turn, sanitized: known values of the session get their tokens, new ones the next free numbers."""
    known = session_maps(tokens)
    first = outputs.join(known, "conv_id", "left").withColumn("text", apply_token_map(F.coalesce("text", F.lit("")), F.coalesce("token_map", F.array().cast("array<struct<token:string,type:string,original_value:string>>"))))
    found = session_mentions(first.select("conv_id", "turn", "text"), rules)
    new = found.groupBy("conv_id", F.col("core").alias("original_value")).agg(F.min(F.struct("turn", "rule_seq", "ord", "type")).alias("at"))
    counters = tokens.groupBy("conv_id", "type").agg(F.max("n").alias("last"))
    n = F.row_number().over(Window.partitionBy("conv_id", "type").orderBy("at.turn", "at.rule_seq", "at.ord", "original_value"))
    new = new.withColumn("type", F.col("at.type")).join(counters, ["conv_id", "type"], "left").withColumn("n", n + F.coalesce("last", F.lit(0)))
    named = new.select("conv_id", "type", "original_value", F.concat(F.lit("["), "type", F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("token"))
    fresh = session_maps(named).withColumnRenamed("token_map", "fresh")
    body = F.when(F.col("fresh").isNull(), F.col("text")).otherwise(apply_token_map(F.col("text"), F.col("fresh")))
    return first.join(fresh, "conv_id", "left").select("conv_id", "turn", body.alias("sanitized"))


def last_user_message(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text of the last user turn of each conversation."""
    users = turns.filter("role = 'user'")
    return users.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")


def rehydrate_args(args: Column, token_map: Column) -> Column:
    """JSON arguments with real values: values are escaped, so the JSON stays JSON; keys have no tokens."""
    plain = lambda s: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(s.alias("v"))), "^\\{\"v\":\"", ""), "\"\\}$", "")
    escaped = F.transform(token_map, lambda e: F.struct(e["token"].alias("token"), plain(e["original_value"]).alias("original_value")))
    return rehydrate(args, escaped, clean_orphans=False)


def parse_args(args: Column) -> Column:
    """Tool arguments as JSON text; {} for what isn't JSON."""
    return F.when(F.try_parse_json(args).isNotNull(), args).otherwise(F.lit("{}"))


def answer_calls(calls: DataFrame, known_tools: tuple[str, ...]) -> DataFrame:
    """Tool result messages of a dry run: the arguments of known tools, an error for others."""
    error = F.to_json(F.struct(F.concat(F.lit("unknown tool: "), "name").alias("error")))
    return calls.select("conv_id", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"), F.when(F.col("name").isin(*known_tools), parse_args(F.col("args"))).otherwise(error).alias("content"))


def rehydrate_session(turns: DataFrame, tokens: DataFrame, clean_orphans: bool = False) -> DataFrame:
    """conv_id, turn, restored: tokens of turns (conv_id, turn, text) back to the values of their session."""
    joined = turns.join(session_maps(tokens), "conv_id", "left")
    known = F.coalesce("token_map", F.array().cast("array<struct<token:string,type:string,original_value:string>>"))
    return joined.select("conv_id", "turn", rehydrate(F.coalesce("text", F.lit("")), known, clean_orphans).alias("restored"))


def replay(turns: DataFrame, rules: tuple[Rule, ...] = RULES, max_turns: int = 10) -> DataFrame:
    """conv_id, answers, finished, final: a recorded agent loop over masked messages.

    The loop ends with the last answer, or with the one that max_turns allows; that one comes back with real values.
    """
    masked = redact_session(turns, rules).filter("role = 'assistant'").select("conv_id", "turn", F.col("sanitized").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    numbered = masked.withColumn("n", place)
    last = numbered.filter(F.col("n") <= max_turns).groupBy("conv_id").agg(F.max("n").alias("answers"), F.max_by(F.struct("turn", "text"), "turn").alias("m"))
    every = numbered.groupBy("conv_id").agg(F.count("*").alias("all"))
    ends = rehydrate_session(last.select("conv_id", "m.turn", "m.text"), session_tokens(turns, rules))
    out = last.join(every, "conv_id").join(ends, "conv_id")
    return out.select("conv_id", F.col("answers").cast("long").alias("answers"), (F.col("all") <= max_turns).alias("finished"), F.col("restored").alias("final"))
