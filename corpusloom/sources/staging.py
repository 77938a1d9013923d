"""Tables written once in the shared folder, so that a result used twice is computed once and survives lost executors."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpusloom-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is set (tests, local mode)."""
    return spark.conf.get("spark.checkpoint.dir", None) or own_dir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own; the folder's owner clears it, as with checkpoints."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
