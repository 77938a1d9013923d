"""Command line over the queries and plans: python -m corpusloom.cli COMMAND."""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sampling import ratio_for
from .plans.build import build_corpus
from .plans.manifest import experiment_index, release_manifest, write_manifest
from .queries import queries
from .sources.text import read_blocks


def spec(text: str) -> tuple[str, float]:
    name, _, ratio = text.partition("=")
    return name, float(ratio)


def shown(result: DataFrame, out: str | None, rows: int) -> None:
    if out:
        result.write.mode("overwrite").parquet(out)
    else:
        result.show(rows, truncate=80)


def corpus(spark: SparkSession, folder: str, ratios: list[tuple[str, float]]) -> DataFrame:
    """Blocks of the text files of a folder, split and marked; ratios cut down the train part of sources by prefix."""
    blocks = read_blocks(spark, folder).withColumn("id", F.sha2("block", 256))
    return build_corpus(blocks, ratio_for(F.col("source"), ratios) if ratios else None)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("query", choices=sorted(queries()))
    data = commands.add_parser("corpus", help="build a corpus from a folder of text files")
    data.add_argument("--source-ratio", action="append", type=spec, default=[], metavar="PREFIX=RATIO")
    index = commands.add_parser("index", help="rank the experiments below a folder")
    release = commands.add_parser("release", help="list the files of a release with digests")
    release.add_argument("--refresh", action="store_true", help="replace a manifest that is there")
    for command in (run, data, index, release):
        command.add_argument("folder")
        command.add_argument("--show", type=int, default=20, help="rows to print where no --out is given")
        command.add_argument("--out", help="folder for the result")
    chosen = parser.parse_args(arguments)
    if chosen.command == "list":
        print("\n".join(sorted(queries())))
        return
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if chosen.command == "run":
        shown(queries()[chosen.query](spark, chosen.folder), chosen.out, chosen.show)
    elif chosen.command == "corpus":
        shown(corpus(spark, chosen.folder, chosen.source_ratio), chosen.out, chosen.show)
    elif chosen.command == "index":
        shown(experiment_index(spark, chosen.folder), chosen.out, chosen.show)
    elif chosen.out:
        write_manifest(release_manifest(spark, chosen.folder), chosen.out, chosen.refresh)
    else:
        shown(release_manifest(spark, chosen.folder), None, chosen.show)


if __name__ == "__main__":
    main()
