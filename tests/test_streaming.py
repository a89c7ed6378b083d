"""Streams give what their batch twins give."""

import time

import pytest
from pyspark.sql import functions as F

from snapdelta.streaming import inflight, merge, progress


def drain(df, mode, name, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_latest_by_key(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    cols = ["user_id", "event_type", "ts", "event_id", "value"]
    stream = progress.latest_by_key(progress.event_stream(spark, small, schema).select(cols), ["user_id", "event_type"])
    batch = progress.latest_by_key(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(cols), ["user_id", "event_type"])
    got = drain(stream, "complete", "latest", spark, tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}


def test_first_in_window(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    got = drain(progress.first_in_window(progress.event_stream(spark, small, schema), ["user_id"], "60 days"), "append", "firsts", spark, tmp_path)
    assert got.count() == spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()


def test_breaker_stream_equals_batch(spark, small, tmp_path):
    def calls(df):
        return df.select(F.col("user_id").alias("key"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"))

    table = spark.read.parquet(f"{small}/events.parquet")
    got = drain(progress.breaker_stream(calls(progress.event_stream(spark, small, table.schema))), "update", "breakers", spark, tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in progress.breaker_batch(calls(table)).collect()}


def test_passes_merge_without_a_lock(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet")
    folder = str(tmp_path / "passes")
    for kind in ("view", "click"):
        stream = progress.event_stream(spark, small, table.schema).where(F.col("event_type") == kind).select("user_id", "event_id", F.col("value").alias(kind))
        q = merge.pass_writer(stream, folder, kind, str(tmp_path / f"checkpoint-{kind}")).start()
        q.processAllAvailable()
        q.stop()
    got = merge.current(spark, folder, ["user_id"], ["view", "click"], "event_id")
    said = table.select("user_id", "event_id", *(F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("view", "click"))).where("event_type in ('view', 'click')")
    want = merge.merged_rows(said, ["user_id"], ["view", "click"], "event_id")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(inflight.STORE[0])
    spark.conf.set(*inflight.STORE)
    yield spark
    spark.conf.set(inflight.STORE[0], before)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


EVENTS = "key string, event_id long, at long, kind string, job string"


def test_in_flight_ends_with_its_job(rocks, tmp_path):
    folder = str(tmp_path / "asked")
    first = [("k", 1, 1, "start", "a"), ("k", 2, 2, "start", "b"), ("k", 3, 3, "end", "b"), ("k", 4, 4, "start", "c"), ("other", 5, 4, "start", "d")]
    later = [("k", 6, 5, "end", "a"), ("k", 7, 6, "start", "e"), ("k", 8, 6, "start", "f"), ("other", 9, 7, "start", "g")]
    put(rocks, folder, first, EVENTS)
    stream = inflight.in_flight(rocks.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.outputMode("append").format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    put(rocks, folder, later, EVENTS)  # the state of the first batch meets the second
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in rocks.table("asked").collect()}
    want = {("k", 1, "a", True), ("k", 2, "a", False), ("k", 4, "a", False), ("other", 5, "d", True), ("k", 7, "e", True), ("k", 8, "e", False), ("other", 9, "d", False)}
    assert got == want
    assert {tuple(r) for r in inflight.in_flight_batch(rocks.createDataFrame(first + later, EVENTS)).collect()} == want


PROGRESS = "key string, event_id long, at long, current long, complete boolean"


def test_a_silent_session_is_told_without_a_further_event(rocks, tmp_path):
    folder = str(tmp_path / "progress")
    put(rocks, folder, [("silent", 1, 1, 3, False), ("done", 2, 1, 5, False), ("done", 3, 2, 6, True)], PROGRESS)
    stream = inflight.stuck_sessions(rocks.readStream.schema(PROGRESS).parquet(folder), after=2.0)
    q = stream.writeStream.outputMode("append").format("memory").queryName("stuck").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and not rocks.table("stuck").count():
        time.sleep(0.5)
    time.sleep(3)
    q.stop()
    told = rocks.table("stuck").collect()
    assert [(r.key, r.current) for r in told] == [("silent", 3)] and told[0].still_ms >= 2000


def test_a_late_subscriber_gets_no_replay(spark, tmp_path):
    source, feed, schema = str(tmp_path / "source"), str(tmp_path / "feed"), "job string, turn long"

    def publish(rows):
        put(spark, source, rows, schema)
        q = progress.publish(spark.readStream.schema(schema).parquet(source), feed, str(tmp_path / "published")).start()
        q.processAllAvailable()
        q.stop()

    publish([("a", 1), ("a", 2)])
    late = spark.sql("select cast(current_timestamp() as string)").first()[0]
    publish([("a", 3), ("b", 1)])
    early = drain(progress.subscribe(spark, feed, schema).select("job", "turn"), "append", "early", spark, tmp_path)
    assert {tuple(r) for r in early.collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1)} and early.count() == 4
    after = drain(progress.subscribe(spark, feed, schema, late).select("job", "turn"), "append", "late", spark, tmp_path)
    assert {tuple(r) for r in after.collect()} == {("a", 3), ("b", 1)}
