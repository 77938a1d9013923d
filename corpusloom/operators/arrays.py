"""Array columns as Arrow arrays: a batch's lists are one flat array and its offsets, so no element is interpreted by itself.

A null list gives null; nulls within a list stay, and are none of the numbers that are added up. Each function of
columns has one of Arrow arrays, named _of; by_pieces() makes a UDF of several in a row, whose arrays never leave it.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are worked on at a time: a batch of texts has tens of MB, which at several arrays of 8 bytes an element are gigabytes.
PIECE = 1 << 18
TOTALS = "struct<n: bigint, total: bigint, places: bigint>"


def pieces(columns: tuple[pa.Array, ...], most: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """A batch's columns by runs of rows, each with at most so many elements (bytes of a text) before its last row."""
    length = pc.list_value_length if pa.types.is_nested(columns[0].type) else pc.binary_length
    ends = pc.fill_null(length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    run = np.concatenate([[0], ends[:-1]]) // (most or PIECE)
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(ends)]
    for begin, end in zip(edges[:-1], edges[1:]):
        yield tuple(c.slice(begin, end - begin) for c in columns)


def piecewise(work: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A function of Arrow arrays that works on their pieces one after the other, so that only its results grow with a batch."""
    return lambda *batch: pa.concat_arrays([work(*piece) for piece in pieces(batch)])


def by_pieces(kind: str, work: Callable[..., pa.Array], *columns: Column) -> Column:
    """A column of what a function of Arrow arrays makes, piecewise, of text or array columns."""
    whole = piecewise(work)

    @F.arrow_udf(kind)
    def udf(*batch: pa.Array) -> pa.Array:
        return whole(*batch)

    return udf(*columns)


def opened(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values, begin, end): the flat values of a batch's lists, and for each value where its list begins and ends."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = sizes.cumsum()
    return lists.flatten(), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)


def lists_of(values: pa.Array, sizes: pa.Array) -> pa.Array:
    """Flat values as lists of the sizes given, null where a size is null."""
    offsets = np.concatenate([[0], pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).cumsum()])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=sizes.is_null())


def closed(values: pa.Array, like: pa.Array) -> pa.Array:
    """Flat values as lists of the sizes, and with the nulls, of another array."""
    return lists_of(values, pc.list_value_length(like))


def code_points_of(texts: pa.Array) -> pa.Array:
    text = "".join(t for t in texts.to_pylist() if t is not None)
    values = pa.array(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<i4"))
    return lists_of(values, pc.utf8_length(texts))


def code_points(text: Column) -> Column:
    """array<int> of a text's code points."""
    return by_pieces("array<int>", code_points_of, text)


def ahead_of(lists: pa.Array, n: int) -> pa.Array:
    values, _, end = opened(lists)
    at = np.arange(len(values)) + n
    return closed(values.take(pa.array(np.where(at < end, at, 0), mask=at >= end)).cast(pa.int32()), lists)


def ahead(ids: Column, n: int) -> Column:
    """For each element the one n places further on, null past the end."""
    return by_pieces("array<int>", lambda lists: ahead_of(lists, n), ids)


def where_true_of(lists: pa.Array, masks: pa.Array, otherwise: int) -> pa.Array:
    kept = pc.if_else(pc.fill_null(masks.flatten(), False), lists.flatten(), pa.scalar(otherwise, lists.type.value_type))
    return closed(kept.cast(pa.int32()), lists)


def where_true(values: Column, mask: Column, otherwise: int) -> Column:
    """array<int> of values where the mask of the same length is true, and a number where it is false or null."""
    both = (F.when(mask.isNotNull(), values), F.when(values.isNotNull(), mask))
    return by_pieces("array<int>", lambda lists, masks: where_true_of(lists, masks, otherwise), *both)


def totals_of(lists: pa.Array, ignored: int | None = None) -> pa.Array:
    values, begin, _ = opened(lists)
    counts = pc.is_valid(values) if ignored is None else pc.fill_null(pc.not_equal(values, ignored), False)
    counts = counts.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64) * counts
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate([[0], sizes.cumsum()])
    sums = [np.diff(np.concatenate([[0], x.cumsum()])[edges]) for x in (counts, plain, plain * (np.arange(len(plain)) - begin))]
    none = pa.array(sums[0] == 0)
    columns = [pa.array(sums[0]), *(pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(s)) for s in sums[1:])]
    return pa.StructArray.from_arrays(columns, names=["n", "total", "places"])


def totals(ids: Column, ignored: int | None = None) -> Column:
    """struct<n, total, places>: how many elements count, their sum, and that of each times its place; null sums for none."""
    return by_pieces(TOTALS, lambda lists: totals_of(lists, ignored), ids)
