"""Documents on their way through processing steps: a fold over their events, in batch and in a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "step int, status string, attempt int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Chain:
    """Steps in order. An event is `done` or `failed` for the step at hand, `stale` where none came in time, or `ensure`, which starts a document or revives one that failed."""

    steps: Sequence[str]
    attempts: int = 3

    def after(self, step: int, status: str, attempt: int, event: str) -> tuple[int, str, int]:
        if event == "ensure" and status in ("", "failed"):
            return step, "waiting", 0
        if status != "waiting":
            return step, status, attempt
        if event == "done":
            return (step, "finished", attempt + 1) if step + 1 == len(self.steps) else (step + 1, "waiting", 0)
        if event in ("failed", "stale"):
            return step, "failed" if attempt + 1 >= self.attempts else "waiting", attempt + 1
        return step, status, attempt

    def folded(self, events: Column) -> Column:
        """The state after an array of events in order, as a struct of step, status and attempt."""
        start = F.struct(F.lit(0).alias("step"), F.lit("").alias("status"), F.lit(0).alias("attempt"))

        def go(s: Column, e: Column) -> Column:
            put = lambda step, status, attempt: F.struct(step.alias("step"), status.alias("status"), attempt.alias("attempt"))
            tried = s["attempt"] + 1
            last = s["step"] + 1 == len(self.steps)
            done = put(F.when(last, s["step"]).otherwise(s["step"] + 1), F.when(last, F.lit("finished")).otherwise(F.lit("waiting")), F.when(last, tried).otherwise(0))
            lost = put(s["step"], F.when(tried >= self.attempts, F.lit("failed")).otherwise(F.lit("waiting")), tried)
            waiting = s["status"] == "waiting"
            return F.when((e == "ensure") & s["status"].isin("", "failed"), put(s["step"], F.lit("waiting"), F.lit(0))).when(waiting & (e == "done"), done).when(waiting & e.isin("failed", "stale"), lost).otherwise(s)

        return F.aggregate(events, start, go)


def states(events: DataFrame, chain: Chain, key: str, order: Sequence[str]) -> DataFrame:
    """(key, step, status, attempt, name) after all events (key, event, order columns)."""
    grouped = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "event"))).alias("e"))
    out = grouped.select(key, chain.folded(F.transform("e", lambda x: x["event"])).alias("s")).select(key, "s.*")
    return out.withColumn("name", F.get(F.array(*[F.lit(x) for x in chain.steps]), F.col("step")))


class StepProcessor(StatefulProcessor):
    """One document's place in a chain as keyed state, with a timer that recovers a step from which nothing was heard."""

    def __init__(self, chain: Chain, patience_ms: int):
        self.chain, self.patience = chain, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _wait(self, status: str, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "waiting":
            self.handle.registerTimer(now + self.patience)

    def _follow(self, key: tuple, events: list[tuple[int, str]]) -> Iterator[Row]:
        now = tuple(self.state.get()) if self.state.exists() else (0, "", 0)
        for at, event in events:
            new = self.chain.after(*now, event)
            if new != now:
                now = new
                self._wait(now[1], at)
                yield Row(key=key[0], at=at, event=event, step=now[0], status=now[1], attempt=now[2])
        self.state.update(now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._follow(key, sorted((int(r.at.timestamp() * 1000), r.event) for r in rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        while True:  # time may have moved on by more than one wait
            yield from self._follow(key, [(at, "stale")])
            at += self.patience
            if self.state.get()[1] != "waiting" or at > timerValues.getCurrentWatermarkInMs():
                return

    def close(self) -> None:
        pass


def step_changes(events: DataFrame, chain: Chain, patience: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, at, event, step, status, attempt): a row for each change of a stream of events (key long, event, at timestamp).

    State is kept per key in a RocksDB store (the session has to name it, see STORE and ROCKS), so a query that stops goes on where its checkpoint left it.
    A document that waits longer than `patience` in event time counts as stale: its step is tried again, or fails on its last attempt.
    """
    ms = interval_ms(patience)
    keyed = events.select("key", "event", "at").withWatermark("at", late).groupBy("key")
    return keyed.transformWithState(StepProcessor(chain, ms), "key long, at long, event string, step int, status string, attempt int", "append", "EventTime")


def interval_ms(text: str) -> int:
    """Milliseconds of a number of seconds, minutes, hours or days."""
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
