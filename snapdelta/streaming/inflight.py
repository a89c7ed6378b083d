"""Jobs in flight, and sessions that stand still: state that ends with a job, and timers that need no further event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that state of this kind needs; the session must name it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ASKED = "key string, event_id long, job string, is_new boolean"


def step(running: str | None, kind: str, job: str) -> tuple[str | None, tuple[str, bool] | None]:
    """One event against the job that runs: what runs then, and the answer to a start. A start while a job runs gets that
    job; the end of another job than the one that runs changes nothing."""
    if kind == "end":
        return (None if job == running else running), None
    return (running, (running, False)) if running is not None else (job, (job, True))


class _InFlight(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._running = handle.getValueState("running", "job string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        running = self._running.get()[0] if self._running.exists() else None
        out = []
        for event_id, kind, job in pd.concat(list(rows)).sort_values(["at", "event_id"])[["event_id", "kind", "job"]].itertuples(index=False):
            running, answer = step(running, kind, job)
            if answer:
                out.append((key[0], event_id, *answer))
        if running is None:
            self._running.clear()
        else:
            self._running.update((running,))
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "job", "is_new"])

    def close(self) -> None:
        pass


def in_flight(events: DataFrame) -> DataFrame:
    """A stream (key, event_id, at, kind, job) of starts and ends to an answer for each start: the job that does the work,
    and whether it is a new one. A key has state only while a job runs. A micro-batch's events of one key are put in order
    by (at, event_id)."""
    return events.groupBy("key").transformWithStateInPandas(_InFlight(), ASKED, "append", "none")


def in_flight_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table: a key's events are read in order, in batches of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, running = None, None
        for rows in batches:
            out = []
            for key, event_id, kind, job in rows[["key", "event_id", "kind", "job"]].itertuples(index=False):
                running = running if key == last else None
                last = key
                running, answer = step(running, kind, job)
                if answer:
                    out.append((key, event_id, *answer))
            yield pd.DataFrame(out, columns=["key", "event_id", "job", "is_new"])

    return events.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, ASKED)


class _Stuck(StatefulProcessor):
    def __init__(self, after: float, forget: float):
        self.after, self.forget = int(after * 1000), int(forget * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self._seen = handle.getValueState("seen", "current long, advanced long", self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        last = pd.concat(list(rows)).sort_values(["at", "event_id"]).iloc[-1]
        seen = self._seen.get() if self._seen.exists() else None
        if bool(last["complete"]):
            self._seen.clear()
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        elif seen is None or seen[0] != int(last["current"]):
            self._seen.update((int(last["current"]), now))
            self.handle.registerTimer(now + self.after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self._seen.get() if self._seen.exists() else None
        due = expiredTimerInfo.getExpiryTimeInMs()
        if seen is not None and seen[1] + self.after <= due:  # else it has moved on since, and a later timer tells
            return iter([pd.DataFrame({"key": [key[0]], "current": [seen[0]], "still_ms": [due - seen[1]]})])
        return iter(())

    def close(self) -> None:
        pass


def stuck_sessions(progress: DataFrame, after: float = 30.0, forget: float = 86_400.0) -> DataFrame:
    """A stream (key, event_id, at, current, complete) to (key, current, still_ms), a row for each session whose ``current``
    has not changed for ``after`` seconds of processing time. A timer tells it, without a further event; it is told once
    for each standstill. A complete session has no state; one that no one hears of for ``forget`` seconds loses it."""
    return progress.groupBy("key").transformWithStateInPandas(_Stuck(after, forget), "key string, current long, still_ms long", "append", "processingTime")
