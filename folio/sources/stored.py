"""Intermediate tables: written to the folder that the cluster shares and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the context's checkpoint folder, with one folder in it for each
    application. A master on this machine alone, as in tests, gets a new temporary one if both are unset; any other raises an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/folio-{context.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: what is built on it neither grows its plan nor works it out again, and lost executors take nothing of it along."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
