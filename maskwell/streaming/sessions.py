"""Sessions on a stream: numbers of values are kept as state of each conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import RULES, Rule
from ..operators.sessions import session_mentions

_OUT = "conv_id long, turn long, type string, original_value string, token string"
#: Conversations that are silent for so long are forgotten.
SILENCE_MS = 24 * 3600 * 1000


def _number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known, counters = ({}, {}) if not state.exists else (dict(zip(*[iter(state.get[0])] * 2, strict=True)), dict(zip(state.get[1], state.get[2], strict=True)))
    rows = pd.concat(list(parts)).sort_values(["turn", "rule_seq", "ord", "core"])
    out = []
    for r in rows.itertuples():
        if r.core not in known:
            counters[r.type] = counters.get(r.type, 0) + 1
            known[r.core] = f"[{r.type}_{counters[r.type]}]"
            out.append((key[0], r.turn, r.type, r.core, known[r.core]))
    state.update(([x for kv in known.items() for x in kv], list(counters), list(counters.values())))
    state.setTimeoutDuration(SILENCE_MS)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "type", "original_value", "token"])


def stream_tokens(turns: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New tokens of each conversation as turns arrive; equal to session_tokens() if they arrive in order.

    Detection is stateless and runs before the shuffle by conversation. What was given out is never renumbered.
    """
    found = session_mentions(turns, rules).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "rule_seq", "ord", "core", "type")
    return found.groupBy("conv_id").applyInPandasWithState(_number, _OUT, "known array<string>, types array<string>, numbers array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window of event time, with a bound on lateness; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
