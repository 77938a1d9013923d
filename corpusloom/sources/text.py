"""Reading and writing text corpora, logs, result files and token streams."""

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .files import list_files, locate
from .token_sink import TokenSink, register, shards

RESULTS = "step INT, `train/loss` DOUBLE, `val/loss` DOUBLE, lr DOUBLE, mfu DOUBLE, time DOUBLE"
READ_BYTES = 1 << 22
ROW_BITS = (1 << 33) - 1  # of monotonically_increasing_id


def exists(path: str) -> bool:
    store, inside = locate(path)
    return store.get_file_info(inside).is_file


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(source, block): the blocks of *.txt files, split at empty lines, stripped, without empty ones."""
    rows = spark.read.option("lineSep", "\n\n").option("pathGlobFilter", "*.txt").text(path)
    named = rows.select(F.col("_metadata.file_name").alias("source"), strip(F.col("value")).alias("block"))
    return named.where("block <> ''")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(source, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def read_log_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_no, value): lines of JSON logs below a folder. line_no orders the lines of a file.

    Files are split, so line_no is the line's number only where a task read the file alone and from its begin. A task reads
    fewer lines than twice the bytes of a split, which keeps the numbers of a later split above those of an earlier.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    number = 2 * F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(ROW_BITS)
    lines = files.select(F.col("_metadata.file_path").alias("path"), number.alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.where("value <> ''")


def read_rows(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """JSON rows of a schema; rows that don't parse are left out. most caps the raw rows, not the good ones."""
    return good_rows(parsed_rows(spark, path, schema, most))


def parsed_rows(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """(row, bad) of JSON lines that are not empty: bad is the line where it is no JSON object of the schema, else null.

    from_json gives a row of nulls for a bad line, so what it could not read is kept in a field of its own.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    raw = raw.limit(most) if most else raw
    row = F.from_json("value", f"{schema}, __bad STRING", {"columnNameOfCorruptRecord": "__bad"})
    found = raw.select(row.alias("row"), "value")
    bad = F.when(F.col("row").isNull(), F.col("value")).otherwise(F.col("row.__bad"))
    return found.select(F.col("row").dropFields("__bad").alias("row"), bad.alias("bad"))


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("bad is null").select("row.*")


def observed_rows(parsed: DataFrame, name: str = "read") -> tuple[DataFrame, Observation]:
    """The good rows of parsed_rows(), and what the same pass over them counts: n lines read and n_bad that did not parse.

    The counts are there (Observation.get) once an action has read the rows; nothing is read for them alone.
    """
    seen = Observation(name)
    counted = parsed.observe(seen, F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_bad"))
    return good_rows(counted), seen


def bad_count(parsed: DataFrame) -> DataFrame:
    """One row: lines read, and how many of them did not parse."""
    return parsed.agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_bad"))


def read_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Metric series (arm, step, train_loss, val_loss, lr, mfu, time); the arm is the file's folder.

    Cells that are not numbers become null, or fail the read if strict.
    """
    reader = spark.read.option("header", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.schema(RESULTS).csv(path, recursiveFileLookup=True, pathGlobFilter="results.csv")
    arm = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    return rows.select(
        arm.alias("arm"), "step", F.col("`train/loss`").alias("train_loss"), F.col("`val/loss`").alias("val_loss"), "lr", "mfu", "time"
    ).where("step is not null")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(source, part, ids): token files of unsigned 16-bit numbers, in parts of bounded size, in order of part.

    Where a list of shards says which files are those of the last write, only they are read. Parts are dealt over tasks,
    and a task reads only its ranges of a file; an odd last byte is no token.
    """
    begins = F.when(F.col("length") > 1, F.sequence(F.lit(0).cast("long"), F.col("length") - 2, F.lit(READ_BYTES).cast("long")))
    files = list_files(spark, path, "*.bin", nested=False)
    listed = shards(path)
    if listed is not None:
        names = spark.createDataFrame([(name,) for name, _ in listed], "shard string")
        files = files.join(F.broadcast(names), F.regexp_extract("path", "([^/]+)$", 1) == F.col("shard"), "left_semi")
    parts = files.select("path", "length", F.posexplode(begins).alias("part", "begin"))

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length, part, begin in batch.itertuples(index=False):
                store, inside = locate(name)
                with store.open_input_file(inside) as f:
                    content = f.read_at(min(READ_BYTES, (length - begin) // 2 * 2), begin)
                yield pd.DataFrame({"source": [name.rsplit("/", 1)[-1]], "part": [part], "ids": [np.frombuffer(content, dtype="<u2").astype(np.int32)]})

    return parts.repartition("path", "part").mapInPandas(ids, "source string, part int, ids array<int>")


def discover_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, has_model, has_results) of the folders right below path that hold best.pt or results.csv."""
    files = list_files(spark, path, "{best.pt,results.csv}")
    inside = F.regexp_extract("path", rf"{re.escape(path.rstrip('/'))}/([^/]+)/([^/]+)$", 1)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    found = files.select(inside.alias("run"), name.alias("name")).where("run <> ''")
    return found.groupBy("run").agg(F.bool_or(F.col("name") == "best.pt").alias("has_model"), F.bool_or(F.col("name") == "results.csv").alias("has_results"))


def sha256_of(path: Column) -> Column:
    """Digest of a file, read as a stream."""

    @F.pandas_udf("string")
    def udf(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            store, inside = locate(path)
            digest = hashlib.sha256()
            with store.open_input_stream(inside, compression=None) as f:
                while block := f.read(READ_BYTES):
                    digest.update(block)
            return digest.hexdigest()

        return paths.map(one)

    return udf(path)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size_bytes, sha256, mtime) of the files below a folder."""
    files = list_files(spark, path, pattern)
    return files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("size_bytes"), sha256_of(F.col("path")).alias("sha256"), F.col("modificationTime").alias("mtime")
    )


def folder_size(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row: how many files there are below a folder, and their bytes."""
    return list_files(spark, path, pattern).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))


def write_blocks(blocks: DataFrame, path: str, order: list[str], mode: str = "ignore") -> None:
    """Blocks as text files, set apart by empty lines, in order across the files; an existing corpus is left alone."""
    ordered = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.concat("block", F.lit("\n")).alias("value")).write.mode(mode).text(path)


def write_tokens(rows: DataFrame, path: str, order: list[str], ids_col: str = "ids") -> int:
    """Token ids in order as files of unsigned 16-bit numbers, named by their place; returns how many ids.

    See token_sink: the files of a write that succeeds replace all earlier ones, those of one that fails are removed.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(ids_col).cast("array<int>").alias("ids"))
    register(rows.sparkSession)
    ordered.write.format(TokenSink.name()).mode("overwrite").save(path)
    return sum(n for _, n in shards(path))


def write_report(rows: DataFrame, path: str, title: str, columns: list[str], order: list[str]) -> None:
    """A Markdown table of rows that are few, as one text file."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"]), "\n")
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    rows.agg(F.concat(F.lit(head), lines).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Add evaluations to a metric series; earlier rows stay."""
    names = {"train_loss": "train/loss", "val_loss": "val/loss"}
    rows.select(*(F.col(c).alias(names.get(c, c)) for c in rows.columns)).write.mode("append").option("header", "true").csv(path)


def metric_sink(path: str, key: tuple[str, ...] = ("arm", "step")) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a batch as a folder of its own, one of each key.

    A batch that is run again, after a failure or restart, replaces its own folder, so it adds nothing.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.dropDuplicates(list(key)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return write


def read_metrics(spark: SparkSession, path: str, key: tuple[str, ...] = ("arm", "step")) -> DataFrame:
    """The series that metric_sink() wrote: of rows with the same key, those of the latest batch."""
    rows = spark.read.parquet(path)
    best = rows.groupBy(*key).agg(F.max_by(F.struct("*"), "batch").alias("row"))
    return best.select(*(F.col(f"row.{c}") for c in rows.columns if c != "batch"))


def read_prompt(spark: SparkSession, given: str) -> DataFrame:
    """One row of text: the words given, or what a file holds if they begin with FILE:."""
    if given.startswith("FILE:"):
        return read_whole(spark, given.removeprefix("FILE:")).select("text")
    return spark.createDataFrame([(given,)], "text string")


def keep_previous(spark: SparkSession, path: str) -> bool:
    """Move what is at path to path.old, of which one generation is kept; says whether anything was there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, old = hadoop(path), hadoop(path.rstrip("/") + ".old")
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(here):
        return False
    if store.exists(old):
        store.delete(old, True)
    return store.rename(here, old)
