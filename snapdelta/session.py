"""Session defaults and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows of a batch for Python workers.
TEXTS_PER_BATCH = 2000


def session(app: str = "snapdelta", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, once for each application, and send them texts in batches of at most
    ``TEXTS_PER_BATCH`` rows unless the session says otherwise: the default of 10,000 documents at once, with copies on
    both sides of the pipe, is most of a worker's memory.

    The sources are zipped (a few tens of KB) and handed to Spark, which serves them to all executors."""
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, "10000") == "10000":
        spark.conf.set(size, TEXTS_PER_BATCH)
    if getattr(sc, "_snapdelta_shipped", None) == sc.applicationId:
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="snapdelta-"), "snapdelta.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(to)
    sc._snapdelta_shipped = sc.applicationId
    return spark
