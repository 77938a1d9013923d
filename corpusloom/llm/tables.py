"""Reading inputs and cutting lineage."""

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that this process has written.
written: list[str] = []


@functools.cache
def own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpusloom-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is set (tests, local mode)."""
    return spark.conf.get("spark.checkpoint.dir", None) or own_dir()


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written so far, or those after the first `since`; the last `keep` stay.

    Results that read them can't be computed after that, so write those first.
    """
    gone = written[since : len(written) - keep]
    del written[since : len(written) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Later jobs then start from files that any executor can reread, so a lost executor costs no
    recomputation, and a result that is used twice is computed once. Unlike checkpoint() the files are
    compressed and columnar, so each reader loads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n lowest different values of a column of long numbers. Each task hands on its own n lowest, so little is shuffled."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, dtype=np.int64)
        for batch in batches:
            held = np.unique(np.concatenate([held, batch[column].to_numpy()]))[:n]
        yield pd.DataFrame({column: held})

    return df.select(column).mapInPandas(least, f"{column} long").distinct().orderBy(column).limit(n)
