"""Reliable materialisation of an intermediate table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def steps_folder(spark: SparkSession) -> str:
    """The folder all executors share, which a cluster names in spark.checkpoint.dir. Only a local master may leave
    it unset (tests, a laptop): then a folder under the warehouse is used."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/_steps"
    return named.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    path = f"{steps_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
