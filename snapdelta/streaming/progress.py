"""Progress events: the latest state of each pass, dedupe of requests in flight, a circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Failures in a row that open the breaker, and the first and longest pause in seconds.
TRIP, FIRST_PAUSE, LONGEST_PAUSE = 3, 20, 300


def event_stream(spark: SparkSession, sf_dir: str, schema) -> DataFrame:
    """The events table read as a stream, its time as an instant (watermarks need one)."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_by_key(events: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Last write wins; the same code for a batch and, in update or complete mode, a stream."""
    rest = [c for c in events.columns if c not in keys]
    by = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("v"), F.count("*").alias("n"))
    return by.select(*keys, *(F.col("v")[c].alias(c) for c in rest), "n")


def first_in_window(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Requests of one key within the watermark's delay count once (in a stream)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def publish(events: DataFrame, folder: str, checkpoint: str):
    """A writer that appends a stream of events to a feed, a folder for each micro-batch with the time of publication. A
    batch that runs again after a failure replaces what it wrote, so a feed holds every event once."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("published_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def subscribe(spark: SparkSession, folder: str, schema: str, since: str | None = None) -> DataFrame:
    """The events of a feed as a stream, from a time of publication on: a late subscriber gets no replay of what came
    before. Without ``since`` all of it is read. ``schema`` is that of the published events."""
    rows = spark.readStream.schema(f"{schema}, published_at timestamp").option("recursiveFileLookup", True).parquet(folder)
    return rows if since is None else rows.where(F.col("published_at") >= F.to_timestamp(F.lit(since)))


def percent(current, most):
    """Progress in percent: 3 before the first turn, a little short of the turn's end, 100 at most."""
    return F.when(current.isNull() | (most <= 0), 3.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (current - 0.08) / most * 100)), 6))


def breaker_step(state: tuple[str, int, float, float], ok: bool, ts: float) -> tuple[tuple[str, int, float, float], bool]:
    """One call against (mode, failures, pause, open until): the new state, and whether the call went through."""
    mode, failed, pause, until = state
    if mode == "open":
        if ts < until:
            return state, False
        mode = "half-open"
    if ok:
        return ("closed", 0, float(FIRST_PAUSE), 0.0), True
    if mode == "half-open":
        pause = min(pause * 2, LONGEST_PAUSE)
        return ("open", failed, pause, ts + pause), True
    failed += 1
    return (("open", failed, pause, ts + pause) if failed >= TRIP else ("closed", failed, pause, 0.0)), True


_OUT = "key long, calls long, refused long, mode string"
_STATE = "mode string, failed int, pause double, until double, calls long, refused long"


def _breaker(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mode, failed, pause, until, calls, refused = state.get if state.exists else ("closed", 0, float(FIRST_PAUSE), 0.0, 0, 0)
    for rows in batches:
        for ok, ts in rows.sort_values(["at", "event_id"])[["ok", "at"]].itertuples(index=False):
            (mode, failed, pause, until), through = breaker_step((mode, failed, pause, until), bool(ok), float(ts))
            calls, refused = calls + 1, refused + (not through)
    state.update((mode, int(failed), float(pause), float(until), int(calls), int(refused)))
    yield pd.DataFrame({"key": [key[0]], "calls": [calls], "refused": [refused], "mode": [mode]})


def breaker_stream(calls: DataFrame) -> DataFrame:
    """(key, event_id, at, ok) as a stream to the state of each key's breaker, kept from batch to batch."""
    return calls.groupBy("key").applyInPandasWithState(_breaker, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def breaker_batch(calls: DataFrame) -> DataFrame:
    """The same over a finished table; a key's calls are read in order, batch by batch of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, n, refused = None, None, 0, 0
        for rows in batches:
            for key, ok, at in rows[["key", "ok", "at"]].itertuples(index=False):
                if key != last:
                    if last is not None:
                        yield pd.DataFrame({"key": [last], "calls": [n], "refused": [refused], "mode": [state[0]]})
                    last, state, n, refused = key, ("closed", 0, float(FIRST_PAUSE), 0.0), 0, 0
                state, through = breaker_step(state, bool(ok), float(at))
                n, refused = n + 1, refused + (not through)
        if last is not None:
            yield pd.DataFrame({"key": [last], "calls": [n], "refused": [refused], "mode": [state[0]]})

    return calls.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, _OUT)
