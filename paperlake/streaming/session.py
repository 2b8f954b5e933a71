"""Keyed session state over a stream of turns; the same step function runs in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, turn long, phase string, unknown_streak int, handoff boolean"
STATE = "turn long, phase string, unknown_streak int, handoff boolean"

# Two unknown turns in a row hand over to a person.
UNKNOWN_LIMIT = 2

#: Which intents move a session on, by phase.
TRANSITIONS = {
    ("greeting", "start"): "guiding",
    ("guiding", "next"): "guiding",
    ("guiding", "finish"): "review",
    ("review", "revise"): "guiding",
    ("review", "confirm"): "done",
}


def step(state: tuple, intent: str) -> tuple:
    """(phase, unknown streak, handoff) after a turn; a handoff is final."""
    phase, streak, handoff = state
    if handoff:
        return state
    streak = streak + 1 if intent == "unknown" else 0
    if streak >= UNKNOWN_LIMIT or intent == "human":
        return "handoff", streak, True
    return TRANSITIONS.get((phase, intent), phase), streak, False


def replay(turns: DataFrame) -> DataFrame:
    """Batch: turns (session, turn, intent) as states after each turn."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, rows = ("greeting", 0, False), []
        for r in part.sort_values("turn", kind="stable").itertuples():
            state = step(state, r.intent)
            rows.append((r.session, r.turn, *state))
        return pd.DataFrame(rows, columns=["session", "turn", "phase", "unknown_streak", "handoff"])

    return turns.select("session", "turn", "intent").groupBy("session").applyInPandas(run, OUT)


def replay_stream(turns: DataFrame) -> DataFrame:
    """Stream: the same states, kept per session between micro-batches."""

    def run(key, parts, held: GroupState):
        phase, streak, handoff = held.get[1:] if held.exists else ("greeting", 0, False)
        state, rows, last = (phase, streak, handoff), [], -1
        for r in pd.concat(list(parts)).sort_values("turn", kind="stable").itertuples():
            state, last = step(state, r.intent), r.turn
            rows.append((key[0], r.turn, *state))
        held.update((last, *state))
        yield pd.DataFrame(rows, columns=["session", "turn", "phase", "unknown_streak", "handoff"])

    return turns.select("session", "turn", "intent").groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) per tumbling window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
