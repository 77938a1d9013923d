"""Manifests: what a corpus, an experiment or a release consists of."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..operators.experiments import rank_arms, summarize
from ..operators.metrics import corpus_totals
from ..sources.text import discover_runs, exists, file_manifest, read_results, sha256_of


def dataset_manifest(docs: DataFrame, files: DataFrame, group: str = "split") -> DataFrame:
    """One row: totals per split and the list of files with sizes and digests. Files of a corpus are few."""
    totals = corpus_totals(docs, [group]).agg(F.array_sort(F.collect_list(F.struct(group, "n_docs", "n_chars"))).alias("splits"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct("file", "size_bytes", "sha256"))).alias("files"), F.sum("size_bytes").alias("size_bytes"))
    return totals.crossJoin(listed)


def experiment_index(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Runs below a folder with the summary of their results, best first, runs without results last.

    only names one run, by itself or as ./run; ranks are still those among all runs.
    """
    runs = discover_runs(spark, path)
    runs = runs.where(F.col("run").isin(only, only.strip("./"))) if only else runs
    summary = rank_arms(summarize(read_results(spark, path)))
    return runs.join(summary, runs["run"] == summary["arm"], "left").drop("arm").orderBy(F.col("rank").asc_nulls_last(), "run")


def release_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a release with digest and readable size."""
    return file_manifest(spark, path).withColumn("size", human_size(F.col("size_bytes")))


def stamp_data(runs: DataFrame, path: str) -> DataFrame:
    """runs with data_manifest_sha256, the digest of the data's manifest file; null for all if there is none."""
    files = runs.sparkSession.createDataFrame([(path,)], "path string")
    digest = files.select(sha256_of(F.col("path")).alias("data_manifest_sha256")) if exists(path) else files.select(F.lit(None).cast("string").alias("data_manifest_sha256"))
    return runs.crossJoin(F.broadcast(digest))  # one row


def write_manifest(manifest: DataFrame, path: str, refresh: bool = False) -> None:
    """Write as JSON; one that is there is kept unless a refresh is asked for."""
    manifest.coalesce(1).write.mode("overwrite" if refresh else "ignore").json(path)
