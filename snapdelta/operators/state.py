"""Tables that change: latest-wins upserts, sweeps, merges of pass results, budgets, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: str, keep_oldest: list[str]) -> DataFrame:
    """The latest row of each key over both; columns of ``keep_oldest`` come from the oldest row."""
    both = table.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), order).alias("_new")
    oldest = F.min_by(F.struct(*rest), order).alias("_old")
    by = both.groupBy(*keys).agg(latest, oldest)
    return by.select(*keys, *(F.col("_old" if c in keep_oldest else "_new")[c].alias(c) for c in rest))


def stale_sweep(analyses: DataFrame, now: str, minutes: int, note: str = "timed out") -> DataFrame:
    """Pending rows not updated for ``minutes`` before ``now`` become errored, with a note to their message."""
    old = (F.col("status") == "pending") & (F.col("updated_at") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(mins=F.lit(minutes)))
    return analyses.withColumn("message", F.when(old, F.concat_ws(" · ", F.col("message"), F.lit(note))).otherwise(F.col("message"))).withColumn("status", F.when(old, "errored").otherwise(F.col("status")))


def recent(analyses: DataFrame, n: int = 50, user: int | None = None) -> DataFrame:
    """The newest ``n`` rows, 200 at most."""
    rows = analyses if user is None else analyses.where(F.col("user_id") == user)
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(min(n, 200))


def feed_stats(analyses: DataFrame) -> DataFrame:
    """Counts by status, and the newest ready row."""
    return analyses.agg(
        F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "errored").alias("errored"),
        F.max(F.when(F.col("status") == "ready", F.struct("updated_at", "id"))).getField("id").alias("resume"),
    )


def merge_passes(flows: DataFrame, passes: dict[str, tuple[DataFrame, list[str]]], key: str = "flow") -> DataFrame:
    """Results of passes joined to the flows: each pass owns its columns, a new value wins over the old, flows
    that only a pass knows are added."""
    out = flows
    for name, (result, columns) in passes.items():
        new = result.select(F.col(key), *(F.col(c).alias(f"_{name}_{c}") for c in columns))
        out = out.join(new, key, "full")
        for c in columns:
            old = F.col(c) if c in out.columns else F.lit(None)
            out = out.withColumn(c, F.coalesce(F.col(f"_{name}_{c}"), old)).drop(f"_{name}_{c}")
    return out


def find_key(analyses: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The artifact key of a ready analysis of each wanted combination of keys (ties: the newest, then the larger id);
    null if there is none."""
    ready = analyses.where("status = 'ready'").groupBy(*keys).agg(F.max(F.struct("updated_at", "id", "artifact_key")).getField("artifact_key").alias("artifact_key"))
    return wanted.select(*keys).distinct().join(ready, keys, "left")


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those of the given keys."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def set_or_cleared(table: DataFrame, changes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The latest value of each key over a table and its changes, by ``order``; a null value clears the key."""
    both = table.select(*keys, value, order).unionByName(changes.select(*keys, value, order))
    return both.groupBy(*keys).agg(F.max_by(F.struct(value), order).alias("_v")).select(*keys, F.col("_v")[value].alias(value)).where(F.col(value).isNotNull())


def resolved_settings(settings: DataFrame, chains: dict[str, list[str]]) -> DataFrame:
    """(scope, name, value) settings to (scope, pass, value): for each pass the first of its names that has a value."""
    order = F.array(*(F.struct(F.lit(p).alias("pass"), F.lit(n).alias("name"), F.lit(i).alias("rank")) for p, names in chains.items() for i, n in enumerate(names)))
    scopes = settings.select("scope").distinct().select("scope", F.explode(order).alias("o")).select("scope", "o.*")
    hit = scopes.join(settings.where("value is not null"), ["scope", "name"])
    return hit.groupBy("scope", "pass").agg(F.min_by("value", "rank").alias("value"))


#: Buckets of a document store; fixed once a store is written.
BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put_documents(rows: DataFrame, folder: str, version: int, key: str = "key", text: str = "json", buckets: int = BUCKETS) -> None:
    """Add documents to a store. A bucket of keys is a folder, a put adds one file sorted by key to each bucket that it
    touches, and of one key the highest ``version`` counts: nothing is rewritten, so puts may overlap."""
    kept = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("json"), F.lit(version).cast("long").alias("version"), _bucket(F.col(key).cast("string"), buckets).alias("bucket"))
    kept.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(folder)


_STORED = "key string, json string, version long, bucket int"


def get_documents(spark, folder: str, wanted: DataFrame, key: str = "key", buckets: int = BUCKETS) -> DataFrame:
    """(key, json) of the wanted keys in a store; null where there is none. Only the buckets of wanted keys are read, and
    within them, by the statistics of sorted files, the rows around few keys."""
    asked = wanted.select(F.col(key).cast("string").alias("key")).distinct().withColumn("bucket", _bucket(F.col("key"), buckets))
    touched = sorted(r[0] for r in asked.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    stored = spark.read.schema(_STORED).parquet(folder).where(F.col("bucket").isin(touched) if touched else F.lit(False))
    found = stored.join(asked.select("bucket", "key"), ["bucket", "key"], "left_semi").groupBy("key").agg(F.max_by("json", "version").alias("json"))
    return asked.select("key").join(found, "key", "left").withColumnRenamed("key", key)


def compact_documents(spark, folder: str, to: str, buckets: int = BUCKETS) -> None:
    """Copy a store to another folder, one file a bucket, the last version of each key only."""
    stored = spark.read.schema(_STORED).parquet(folder)
    last = stored.groupBy("bucket", "key").agg(F.max_by("json", "version").alias("json"), F.max("version").alias("version")).select("key", "json", "version", "bucket")
    last.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.mode("error").partitionBy("bucket").parquet(to)


def running_budget(calls: DataFrame, session: str, order: list[str], amount: Column, most: float) -> DataFrame:
    """The running amount of each session, and the first call that goes beyond ``most``.

    A session's calls are few by contract; the sum runs within it."""
    w = W.partitionBy(session).orderBy(*order)
    run = calls.withColumn("spent", F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return run.groupBy(session).agg(F.sum(amount).alias("total"), F.count("*").alias("calls"), F.min(F.when(F.col("spent") > most, F.col(order[0]))).alias("breach"))


def hash_of(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar; null parts have a stand-in."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("none")) for p in parts)), 256)


def snapshot_hash(rows: DataFrame, row: Column, digits: int = 2) -> DataFrame:
    """One hash over all rows, whatever their order: sha256 of the sorted row hashes by their first ``digits``
    hexadecimal digits, then sha256 of those in order. ``digits`` is chosen so that a bucket fits a task (2 gives
    256 buckets, 5 a million, whose hashes still are one array of 64 MB)."""
    h = rows.select(F.sha2(row, 256).alias("h"))
    line = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    by = h.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.count("*").alias("n"), F.sha2(line("h"), 256).alias("x"))
    text = F.concat_ws(":", F.col("b"), F.col("x"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(line(text), 256).alias("sha"))


def baseline_status(wanted: DataFrame, stored: DataFrame, keys: list[str], now: str, days: int = 60) -> DataFrame:
    """Whether a stored baseline of each wanted key is fresh, stale (older than ``days`` at ``now``) or missing."""
    last = stored.groupBy(*keys).agg(F.max("modified_at").alias("modified_at"))
    limit = F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.lit(days))
    status = F.when(F.col("modified_at").isNull(), "missing").when(F.col("modified_at").cast("timestamp") < limit, "stale").otherwise("fresh")
    return wanted.select(*keys).distinct().join(last, keys, "left").select(*keys, status.alias("status"))


def edited_notes(notes: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(note_id, anchor, text, created_at) after additions (blank ones are refused) and removals by id."""
    clean = added.withColumn("text", F.trim("text")).where("text <> ''")
    new = clean.select(hash_of(F.col("anchor"), F.col("text"), F.col("created_at")).alias("note_id"), "anchor", "text", "created_at")
    return notes.select("note_id", "anchor", "text", "created_at").union(new).join(removed.select("note_id"), "note_id", "left_anti")


def as_document(rows: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """Rows as JSON texts, null fields left out."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns])).alias(name))
