"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity."""

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .tables import materialise

#: Buckets per length within which rows are ranked; bounds the rows of one sort where a length is very common.
SALTS = 1024
PIECES = "piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity that counts the open bins at each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.counts[i] += bins
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that holds length."""
        counts, i = self.counts, length + self.size
        while not counts[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if counts[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over all documents, from the number of documents of each length.

    Documents of one length are alike, so bins that hold the same lengths are handled as one run of bin
    numbers: the rows (length, first rank, bins, documents a bin, first bin, first offset) say that the
    documents of that length, by rank, fill those bins one after the other. This places every document where
    one-at-a-time best-fit decreasing does: once a bin of the tightest class has taken a document it is the
    tightest itself for as long as it holds another.
    """
    tree, runs, rows, opened = CapacityTree(capacity), defaultdict(list), [], 0

    def open_run(remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            runs[remaining].append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            else:
                first, bins = runs[remaining].pop()
                tree.add(remaining, -bins)
            each = remaining // length
            full = min(bins, left // each)
            if full:
                rows.append((length, rank, full, each, first, capacity - remaining))
                open_run(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = bins - full
            if rest and left and left < each:
                rows.append((length, rank, 1, left, first + full, capacity - remaining))
                open_run(remaining - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            open_run(remaining, first + full, bins - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def cut_documents(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.

    A document is its ids followed by end_id; only one longer than capacity is cut, into pieces of capacity
    tokens, of which the last may be shorter. Null texts count as empty (one piece, the end id alone).
    """
    of = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = f"`{id_col}` {of.schema[0].dataType.simpleString()}, {PIECES}"
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.word_bpe(path)
        for batch in batches:
            rows: list[tuple] = []
            ids = (i for run in bpe.in_runs(batch["_text"]) for i in encoder.encode(run))
            for at, packed in zip(batch[id_col].astype(object), ids, strict=True):
                whole = packed + end
                for piece, begin in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[begin : begin + 4 * capacity]
                    rows.append((at, piece, begin // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32"])
            yield out.astype({id_col: batch[id_col].dtype if len(out) else object})

    return of.mapInPandas(pieces, schema)


def pack(pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset, by best-fit decreasing.

    The driver sees the histogram of lengths only, at most `capacity` numbers whatever the input, and plans
    over it. Rows find their place by length and rank. Ranks come from row numbers within (length, salt) plus
    the number of rows in earlier salts, so a length that a third of all rows share is spread over `salts`
    groups. pieces must be cheap to read twice (see materialise()). Repeated rows each get a place of their
    own; null ids are ids like any other; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64(id_col, "piece", "start"), F.lit(salts)).alias("_salt")
    salted = pieces.select("*", salt)
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("_length"),
        F.col("_salt").alias("_of_salt"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = best_fit_plan(histogram, capacity)
    keys = (capacity - rows[:, 0] << 44) + rows[:, 1]  # lengths fall and ranks rise along the plan
    plan = spark.sparkContext.broadcast((rows, keys))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows, keys = plan.value
        at = np.searchsorted(keys, (capacity - length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        _, first_rank, _, each, first_bin, first_offset = rows[at].T
        nth, within = np.divmod(rank.to_numpy() - first_rank, each)
        return pd.DataFrame({"sequence_id": first_bin + nth, "offset": first_offset + within * length.to_numpy()})

    order = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(order) - 1)
    joined = ranked.join(offsets, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_of_salt")))
    placed = joined.withColumn("_place", place("length", F.col("_before") + F.col("_row")))
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", F.col("_place.sequence_id"), F.col("_place.offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """cut_documents() and pack(): every text is tokenised once, its pieces' lengths are kept in a table."""
    return pack(materialise(cut_documents(docs, path, capacity, end_id), "pieces"), capacity)
