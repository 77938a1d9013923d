"""Layers over parallel residual streams: streams compressed into one, a layer applied to it, the result spread and the streams mixed."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def doubly_stochastic(raw: np.ndarray, rounds: int = 20) -> np.ndarray:
    """exp of the softplus of a matrix, rows and columns scaled in turn until both sum to one."""
    m = np.exp(np.logaddexp(0.0, raw))
    for _ in range(rounds):
        m = m / m.sum(1, keepdims=True)
        m = m / m.sum(0, keepdims=True)
    return m


def stream_layer(
    rows: DataFrame, streams: str, compress: list[float], expand: list[float], mixing: list[list[float]],
    layer: Callable[[np.ndarray], np.ndarray], out: str = "streams",
) -> DataFrame:
    """rows with `out`, an array of vectors: each row's streams after one layer.

    The streams (an array of vectors of one dimension) are added up by the sigmoids of `compress`, the layer takes the
    sums of a batch of rows, one a row, to as many vectors, and stream c becomes the sum over h of B[h][c] times stream
    h plus its sigmoid of `expand` times the layer's vector, with B the doubly stochastic matrix of `mixing`. All
    three are one multiplication over a batch's rows. The layer must treat rows by themselves. Null streams stay null;
    other columns pass through. The parameters are small and go with the task.
    """
    a, c, b = sigmoid(np.array(compress)), sigmoid(np.array(expand)), doubly_stochastic(np.array(mixing))
    names = [n for n in rows.columns if n != out]
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(streams)
            flat = held.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(held) - held.null_count, len(a), -1) if len(flat) else np.zeros((0, len(a), 0))
            y = np.einsum("nhd,hc->ncd", x, b) + c[None, :, None] * layer(np.einsum("nhd,h->nd", x, a))[:, None, :]
            dim = x.shape[2]
            there = held.is_valid().to_numpy(zero_copy_only=False)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(y.shape[0] * len(a) + 1, dtype=np.int32) * dim), pa.array(y.ravel()))
            offsets = np.concatenate([[0], (there * len(a)).cumsum()]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), vectors, mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], names=schema.names)

    return rows.mapInArrow(run, schema)
