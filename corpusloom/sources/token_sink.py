"""A sink for token files whose write either takes the place of all earlier files or leaves nothing behind."""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import locate

LISTED = "shards.json"


@dataclass
class Shard(WriterCommitMessage):
    """A file that a task has written, still in the job's own folder."""

    partition: int
    name: str
    n: int


class TokenWriter(DataSourceArrowWriter):
    """Each attempt of a task writes one file into a folder of the job; commit names those of the attempts that count.

    The list of shards is replaced in one step, and it alone says which files are the data: a reader that follows it
    sees the files of one write, before, during and after the commit of another. Files and jobs' folders that it does
    not name are then removed, also those that an earlier driver left when it died.
    """

    def __init__(self, path: str, overwrite: bool):
        if not overwrite:
            raise ValueError("token files are numbered from the first: write them with mode overwrite")
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str, str]:
        store, folder = locate(self.path)
        return store, folder, f"{folder}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        store, _, own = self.place()
        context = TaskContext.get()
        name, n = f"{context.partitionId():06d}-{context.taskAttemptId()}.bin", 0
        store.create_dir(own, recursive=True)
        with store.open_output_stream(f"{own}/{name}") as f:
            for batch in iterator:
                ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
                if len(ids) and not 0 <= ids.min() <= ids.max() <= 0xFFFF:
                    raise ValueError(f"an id is beyond 16 bits: {ids.min()}..{ids.max()}")
                f.write(ids.astype("<u2").tobytes())
                n += len(ids)
        return Shard(context.partitionId(), name, n)

    def commit(self, messages: list[Shard | None]) -> None:
        store, folder, own = self.place()
        store.create_dir(folder, recursive=True)
        listed = []
        for k, shard in enumerate(sorted((m for m in messages if m), key=lambda m: m.partition)):
            name = f"part-{k:06d}-{self.job[:8]}.bin"
            store.move(f"{own}/{shard.name}", f"{folder}/{name}")
            listed.append({"name": name, "n": shard.n})
        with store.open_output_stream(f"{folder}/{LISTED}.{self.job}") as f:
            f.write(json.dumps(listed).encode())
        store.move(f"{folder}/{LISTED}.{self.job}", f"{folder}/{LISTED}")
        names = {x["name"] for x in listed}
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.is_file and info.base_name.endswith(".bin") and info.base_name not in names:
                store.delete_file(info.path)
            elif not info.is_file and info.base_name.startswith("_job-"):
                store.delete_dir(info.path)

    def abort(self, messages: list[Shard | None]) -> None:
        store, _, own = self.place()
        if not store.get_file_info(own).type == fs.FileType.NotFound:
            store.delete_dir(own)


class TokenSink(DataSource):
    """Rows of one column ids, arrays of ints below 65536, as files of unsigned 16-bit numbers in order of partitions."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenSink)


def shards(path: str) -> list[tuple[str, int]] | None:
    """(name, number of ids) of the files of the last write, in order; None where no list says so."""
    store, folder = locate(path.rstrip("/"))
    if not store.get_file_info(f"{folder}/{LISTED}").is_file:
        return None
    with store.open_input_stream(f"{folder}/{LISTED}") as f:
        return [(x["name"], x["n"]) for x in json.loads(f.read())]
