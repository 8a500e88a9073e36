"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else the context's checkpoint folder. Where both are unset, a master on
    this machine alone (``local[...]``, as in tests) gets a new temporary folder; any other raises an error, as its
    executors do not see the driver's disk."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; it can be deleted when the application has ended."""
    return f"{shared_folder(spark)}/folio-{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: this cuts the lineage and
    outlives the executors that made it."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add, whatever their letter case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until none of the columns is called so in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
