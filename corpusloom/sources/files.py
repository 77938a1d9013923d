"""Finding files, and opening them from tasks that stream or read ranges of what is too long for one row."""

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it of a path or address."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def list_files(spark: SparkSession, path: str, pattern: str, nested: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower()).option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "modificationTime")
