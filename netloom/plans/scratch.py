"""Where queries that read files put the files that they make."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; in a temporary one on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="netloom-files-")
    return f"{base.rstrip('/')}/netloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in a new shared folder, for results that several others are made from."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
