"""Results of passes that run at the same time, merged into one table without a lock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def pass_writer(updates: DataFrame, folder: str, name: str, checkpoint: str) -> DataStreamWriter:
    """Writes the updates of one pass, each micro-batch to a folder of its own. A batch that is done again replaces
    what it wrote before, so that the result is the same however often it fails."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/pass={name}/batch={number}")

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def merged_rows(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row for each key: of each column the latest value that is not null. Passes own columns of their own, so they
    never overwrite each other; a column that a row does not say stays as it was."""
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def current(spark: SparkSession, folder: str, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """The merged table of all that the passes have written so far."""
    return merged_rows(spark.read.option("mergeSchema", "true").parquet(folder), keys, columns, order)
