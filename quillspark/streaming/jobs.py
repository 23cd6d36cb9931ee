"""A job's state machine over its events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What each event leads to from each state; anything else leaves the state as it is.
NEXT = {
    ("new", "enqueue"): "queued",
    ("queued", "claim"): "running",
    ("queued", "cancel"): "cancelled",
    ("running", "finish"): "done",
    ("running", "fail"): "failed",
    ("running", "cancel"): "cancelled",
    ("running", "stale"): "queued",
    ("failed", "retry"): "queued",
}


def follow(state: str, attempt: int, events: list[str], most: int = 3) -> tuple[str, int]:
    """The state after the events; a job that is stale or fails on its last attempt has failed for good."""
    for event in events:
        after = NEXT.get((state, event), state)
        if event == "claim" and after == "running" and state == "queued":
            attempt += 1
        if after == "queued" and event in ("stale", "retry") and attempt >= most:
            after = "failed"
        state = after
    return state, attempt


def job_states(events: DataFrame) -> DataFrame:
    """Streaming events (job_id, event, at) to the state of each job after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempt = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(batches)).sort_values("at")
        now, attempt = follow(now, attempt, rows["event"].tolist())
        state.update((now, attempt))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "attempt": [attempt]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, state string, attempt int", "state string, attempt int", "update", GroupStateTimeout.NoTimeout)
