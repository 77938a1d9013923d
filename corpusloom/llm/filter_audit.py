"""How filters interact: what each one removes, in every order in which they could be applied."""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Rows whose first failures in all orders are looked up together, and parts whose counts a task holds.
ROWS, PARTS = 4096, 64
#: What is counted for each part: removals by order and step of all rows, good and toxic ones; failures of each filter.
MEASURES = ("removed", "good", "toxic", "fails", "only")


def first_failures() -> np.ndarray:
    """By mask of failed filters (bit k: filter k) and order: the step, from 0, whose filter removes the row; STEPS if none."""
    places = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
    failed = np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1
    return np.where(failed[:, None, :] > 0, places[None], STEPS).min(2).astype(np.int64)


def failure_mask(text: Column) -> Column:
    """Bits 0 to 3: fewer than 200 words, fewer than half of them distinct, over 3 % capitals, any of #$%&*|."""
    words = F.array_remove(F.split(text, BLANK), "")
    few = F.size(words) < 200
    repeated = F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(50) * F.size(words)
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    loud = F.lit(100) * capitals > F.lit(3) * chars
    signs = F.rlike(text, F.lit(r"[#$%&*|]"))
    bit = lambda failed, k: F.when(failed, 1 << k).otherwise(0)
    return bit(few, 0) + bit(repeated, 1) + bit(loud, 2) + bit(signs, 3)


def partial_counts(rows: DataFrame) -> DataFrame:
    """(part, measure, counts) of each task, from (part, mask, good, toxic) rows; arrays by order and step, or by filter."""
    table, n = first_failures(), len(ORDERS)
    column = np.arange(n) * (STEPS + 1)
    failed = np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1
    alone = (failed.sum(1) == 1)[:, None] * failed

    def lookup(masks: np.ndarray) -> np.ndarray:
        """Rows removed by order and step; the last step of an order counts what it keeps."""
        return np.bincount((table[masks] + column).ravel(), minlength=n * (STEPS + 1))

    def frame(held: dict) -> pa.RecordBatch:
        rows = [(part, name, counts.tolist()) for part, some in held.items() for name, counts in zip(MEASURES, some, strict=True)]
        part, name, counts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array(name, pa.string()), pa.array(counts, pa.list_(pa.int64()))],
            names=["part", "measure", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            masks = batch.column("mask").to_numpy(zero_copy_only=False).astype(np.int64)
            marks = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic")]
            by = np.argsort(codes, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(codes[by])) + 1, [len(by)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                some = held.setdefault(parts.dictionary[int(codes[by[a]])].as_py(), [np.zeros(n * (STEPS + 1), dtype=np.int64) for _ in range(3)] + [np.zeros(STEPS, dtype=np.int64) for _ in range(2)])
                for lo in range(a, b, ROWS):
                    at = by[lo : min(b, lo + ROWS)]
                    some[0] += lookup(masks[at])
                    for k, mark in enumerate(marks, 1):
                        some[k] += lookup(masks[at][mark[at]])
                    seen = np.bincount(masks[at], minlength=1 << STEPS)
                    some[3] += seen @ failed
                    some[4] += seen @ alone
            if len(held) > PARTS:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    return rows.mapInArrow(count, "part string, measure string, counts array<bigint>")


def masked_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, good, toxic) of each document; see audit()."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"),
        failure_mask(text).alias("mask"),
        F.sha2(text, 256).alias("digest"),
    )
    least = docs.select(F.sha2(text, 256).alias("_digest"), F.col(f"`{id_col}`").alias("_least"))
    least = least.groupBy("_digest").agg(F.min("_least").alias("_least"))
    marks = labels.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    first = (F.col("digest") == F.col("_digest")) & (F.col("id") == F.col("_least"))
    copy = F.col("_least").isNull() & F.col("id").isNotNull()
    joined = rows.join(least, first, "left").join(marks, F.col("id") == F.col("_id"), "left")
    return joined.select(
        "part",
        (F.col("mask") + F.when(copy, 1 << (STEPS - 1)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step and what its filter does there.

    Filters A to D see the text (failure_mask()); E fails where an equal text has a smaller id, in any part. kept
    counts the rows left after the step, removed those that go here, redundant those that fail this filter too but
    went before, unique_fails those that fail no other filter; good_lost and toxic_lost are removed rows that `labels`
    (id, quality, toxic) marks 1; shapley is the filter's removals summed over all orders.

    A row's five verdicts are a number below 32. In each task a table of 32 masks by 120 orders gives the step that
    removes each row, and counts by part, order and step are kept; only those arrays leave the task and are summed,
    so what is shuffled for them depends on parts and tasks, not on rows. E and the labels cost a join each, of rows
    without text: the least id of a text is aggregated before it is shuffled, and rows look themselves up by (digest,
    id), so copies of one text are spread by their ids. Texts are equal if their sha256 is.

    Null texts count as empty, a null part as the empty string; a row without an id is no copy and has no label. Rows
    that repeat an id count each, and none of them is a copy of the other. Of labels that repeat an id any 1 counts.
    Other columns are ignored. Parts are those of the rows: an empty table gives an empty result.
    """
    counts = partial_counts(masked_rows(docs, labels, id_col, text_col, part_col))
    each = counts.select("part", "measure", F.posexplode("counts").alias("place", "n"))
    # one array for each part and measure: at most 720 numbers
    summed = each.groupBy("part", "measure", "place").agg(F.sum("n").alias("n"))
    arrays = summed.groupBy("part").agg(
        *(F.transform(F.array_sort(F.collect_list(F.when(F.col("measure") == m, F.struct("place", "n")))), lambda s: s["n"]).alias(f"by_{m}") for m in MEASURES)
    )
    orders = F.array(*map(F.lit, ORDERS))
    rows = arrays.select("*", orders.alias("orders")).select("*", F.posexplode("orders").alias("o", "filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("k"))
    at = F.col("o") * (STEPS + 1)
    letter = F.substring("filter_order", F.col("k") + 1, F.lit(1))
    rows = rows.select("*", letter.alias("letter"), (F.instr(F.lit(FILTERS), letter) - 1).alias("f"), (at + F.col("k")).alias("here"))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    # the filter's step in each order, from its place in the name of the order
    everywhere = F.zip_with(
        "orders", F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)),
        lambda name, o: F.get("by_removed", o * (STEPS + 1) + F.call_function("instr", name, F.col("letter")) - 1),
    )
    removed = F.get("by_removed", F.col("here"))
    gone_before = total(F.slice("by_removed", at + 1, F.col("k")))
    all_rows = total(F.slice("by_removed", at + 1, F.lit(STEPS + 1)))
    return rows.select(
        "part",
        "filter_order",
        (F.col("k") + 1).cast("int").alias("step"),
        (all_rows - gone_before - removed).alias("kept"),
        removed.alias("removed"),
        (F.get("by_fails", F.col("f")) - removed).alias("redundant"),
        F.get("by_only", F.col("f")).alias("unique_fails"),
        F.get("by_good", F.col("here")).alias("good_lost"),
        F.get("by_toxic", F.col("here")).alias("toxic_lost"),
        total(everywhere).alias("shapley"),
    )
