"""Attention with values: softmax sums over blocks of keys, kept as states that merge in any order.

Positions of a sequence are packed into blocks, and a cell is a block of queries with a block of keys that it may see.
A cell gives, for each query and head, the largest score, the sum of exponentials below it and the values weighted by
them; two such states of the same queries merge into one (State). So no task holds more than two blocks of a sequence
and one state, however long the sequence is, and a sequence that is most of the table is many cells.

Rows without a position take no part, rows without a query give none, and rows without a key or value are not seen;
rows that repeat a position are keys and queries of their own. Sequences may be named by any columns, nulls included. Other columns are ignored, empty tables give none.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .attention import attend

#: Positions of a block.
SIZE = 256


@dataclass
class State:
    """Of n queries and h heads: largest score and sum of exponentials (n, h), and values weighted by them (n, h, d)."""

    top: np.ndarray
    total: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(scores: np.ndarray, values: np.ndarray) -> "State":
        """From scores (n, h, m) of m keys, minus infinity where one is not seen, and their values (m, h, d)."""
        top = scores.max(2, initial=-np.inf)
        weights = np.exp(scores - np.where(top == -np.inf, 0.0, top)[:, :, None])
        return State(top, weights.sum(2), np.einsum("nhm,mhd->nhd", weights, values))

    def merge(self, other: "State") -> "State":
        """The state of the keys of both; associative and commutative, but for rounding."""
        top = np.maximum(self.top, other.top)
        under = np.where(top == -np.inf, 0.0, top)
        a, b = np.exp(self.top - under), np.exp(other.top - under)
        return State(top, a * self.total + b * other.total, a[:, :, None] * self.values + b[:, :, None] * other.values)

    def output(self, sink: float | None = None) -> np.ndarray:
        """(n, h, d): the weighted mean of the values; a sink is a score that takes weight and no value. Zero without keys."""
        done = self
        if sink is not None:
            done = self.merge(State(np.full_like(self.top, sink), np.ones_like(self.total), np.zeros_like(self.values)))
            done.values[self.top == -np.inf] = 0.0
        return done.values / np.where(done.total == 0, 1.0, done.total)[:, :, None]


def packed(rows: DataFrame, group: list[str], pos: str, vectors: dict[str, str], size: int, prefix: str) -> DataFrame:
    """(group.., {prefix}block, {prefix}pos, {prefix}{name}..): positions and flattened vectors of blocks of positions."""
    held = F.col(f"`{pos}`").isNotNull()
    for column in vectors.values():
        held &= F.col(f"`{column}`").isNotNull()
    each = F.struct(F.col(f"`{pos}`").cast("long").alias("pos"), *(F.col(f"`{c}`").cast("array<double>").alias(n) for n, c in vectors.items()))
    some = rows.where(held).select(
        *(F.col(f"`{g}`").alias(f"{prefix}g{i}") for i, g in enumerate(group)),
        F.floor(F.col(f"`{pos}`") / size).alias(f"{prefix}block"),
        each.alias("each"),
    )
    keys = [*(f"{prefix}g{i}" for i in range(len(group))), f"{prefix}block"]
    blocks = some.groupBy(*keys).agg(F.array_sort(F.collect_list("each")).alias("each"))
    return blocks.select(
        *keys, F.col("each.pos").alias(f"{prefix}pos"), *(F.flatten(f"each.{n}").alias(f"{prefix}{n}") for n in vectors)
    )


def cells(queries: DataFrame, keys: DataFrame, group: list[str], low, high) -> DataFrame:
    """Each block of queries with each block of keys low..high, by an equi-join on sequence and block of keys."""
    spread = queries.withColumn("at", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    same = F.col("at") == F.col("kblock")
    for i in range(len(group)):
        same &= F.col(f"qg{i}").eqNullSafe(F.col(f"kg{i}"))
    return spread.join(keys, same).drop(*(f"kg{i}" for i in range(len(group))), "at")


def array_of(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


class Folded:
    """States by (branch, block of queries), merged as they come."""

    def __init__(self, group: int):
        self.names = [*(f"qg{i}" for i in range(group)), "qblock"]
        self.held: dict[tuple, tuple[np.ndarray, dict[int, State]]] = {}

    def add(self, key: tuple, pos: np.ndarray, branch: int, state: State) -> None:
        states = self.held.setdefault(key, (pos, {}))[1]
        states[branch] = states[branch].merge(state) if branch in states else state


def key_of(batch: pa.RecordBatch, names: list[str], i: int) -> tuple:
    return tuple(batch.column(n)[i].as_py() for n in names)


def key_fields(frame: DataFrame, group: list[str]) -> list[T.StructField]:
    return [T.StructField(f"qg{i}", frame.schema[f"qg{i}"].dataType) for i in range(len(group))] + [T.StructField("qblock", T.LongType())]


def as_batch(schema: T.StructType, columns: list[list]) -> pa.RecordBatch:
    arrays = [pa.array(c, type=to_arrow_type(f.dataType)) for f, c in zip(schema, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


DOUBLES, LONGS = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())


def states(cell_rows: DataFrame, group: list[str], heads: int, branch: int, score: Callable) -> DataFrame:
    """(group.., qblock, qpos, branch, top, total, values) of cells; those of one block that a batch holds come merged.

    score gives the (n, h, m) scores of a cell from its query and key positions and columns, minus infinity where a
    key is not seen; the cell's values are its column kv.
    """
    schema = T.StructType(
        [*key_fields(cell_rows, group), T.StructField("qpos", LONGS), T.StructField("branch", T.IntegerType())]
        + [T.StructField(n, DOUBLES) for n in ("top", "total", "values")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = Folded(len(group))
            for i in range(batch.num_rows):
                n, m = len(array_of(batch, "qpos", i)), len(array_of(batch, "kpos", i))
                values = array_of(batch, "kv", i).reshape(m, heads, -1)
                scores = score(lambda name, i=i: array_of(batch, name, i), n, m)
                folded.add(key_of(batch, folded.names, i), array_of(batch, "qpos", i), branch, State.of(scores, values))
            out = [(*key, pos, b, s.top.ravel(), s.total.ravel(), s.values.ravel()) for key, (pos, some) in folded.held.items() for b, s in some.items()]
            yield as_batch(schema, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in schema])

    return cell_rows.mapInArrow(run, schema)


def outputs(parts: DataFrame, group: list[str], pos: str, heads: int, sinks: list[float | None]) -> DataFrame:
    """(group.., pos, y): states of the same queries merged, finished with their branch's sink, and branches added up.

    Rows come sorted by block of queries, so a task holds one block's state for each branch at a time.
    """
    keys = [f"qg{i}" for i in range(len(group))]
    schema = T.StructType([*key_fields(parts, group)[:-1], T.StructField("pos", T.LongType()), T.StructField("y", DOUBLES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Folded(len(group))

        def done() -> pa.RecordBatch:
            out = []
            for key, (at, some) in folded.held.items():
                y = sum(state.output(sinks[branch]).reshape(len(at), -1) for branch, state in some.items())
                out += [(*key[:-1], p, row) for p, row in zip(at.tolist(), y, strict=True)]
            folded.held = {}
            return as_batch(schema, [list(c) for c in zip(*out, strict=True)])

        for batch in batches:
            for i in range(batch.num_rows):
                key, at = key_of(batch, folded.names, i), array_of(batch, "qpos", i)
                if folded.held and key not in folded.held:
                    yield done()
                shape = (len(at), heads)
                top, total = (array_of(batch, n, i).reshape(shape) for n in ("top", "total"))
                folded.add(key, at, batch.column("branch")[i].as_py(), State(top, total, array_of(batch, "values", i).reshape(*shape, -1)))
        if folded.held:
            yield done()

    dealt = parts.repartition(*keys, "qblock").sortWithinPartitions(*keys, "qblock")
    done = dealt.mapInArrow(run, schema)
    return done.select(*(F.col(f"qg{i}").alias(g) for i, g in enumerate(group)), F.col("pos").alias(pos), "y")


def dot_scores(column: Callable, n: int, m: int, heads: int, scale: float) -> np.ndarray:
    """(n, h, m) scaled dot products of a cell's queries and keys, head by head."""
    q, k = column("qq").reshape(n, heads, -1), column("kk").reshape(m, heads, -1)
    return np.einsum("nhd,mhd->nhm", q, k) * scale


def band_states(rows: DataFrame, group: list[str], pos: str, q: str, k: str, v: str, heads: int, behind: int | None, ahead: int, scale: float, size: int, branch: int = 0) -> DataFrame:
    """States of queries with the keys from `behind` positions before (null: all) to `ahead` positions after them."""
    queries = packed(rows, group, pos, {"q": q}, size, "q")
    keys = packed(rows, group, pos, {"k": k, "v": v}, size, "k")
    first = F.col("qblock") * size
    low = F.lit(0) if behind is None else F.floor((first - behind) / size)
    found = cells(queries, keys, group, low, F.floor((first + size - 1 + ahead) / size))

    def score(column: Callable, n: int, m: int) -> np.ndarray:
        apart = column("kpos")[None, :] - column("qpos")[:, None]
        seen = (apart <= ahead) if behind is None else (apart <= ahead) & (apart >= -behind)
        return np.where(seen[:, None, :], dot_scores(column, n, m, heads, scale), -np.inf)

    return states(found, group, heads, branch, score)


def attention(
    rows: DataFrame, group: list[str], pos: str, q: str, k: str, v: str, heads: int = 1,
    behind: int | None = None, ahead: int = 0, scale: float = 1.0, sink: float | None = None, size: int = SIZE,
) -> DataFrame:
    """(group.., pos, y): values summed by the softmax of the scaled scores of the keys that each position sees.

    By default attention is causal; `behind` and `ahead` make it a window. Vectors are `heads` parts of equal size, each
    attended to by itself. A sink is one more score, whose value is zero. Positions are 0 or more; vectors of a
    sequence have one dimension. See the module for what a task holds and for nulls.
    """
    return outputs(band_states(rows, group, pos, q, k, v, heads, behind, ahead, scale, size), group, pos, heads, [sink])


def pooled_blocks(rows: DataFrame, group: list[str], pos: str, vectors: dict[str, str], block: int) -> DataFrame:
    """(group.., block, {name}..): means of the vectors of each run of `block` positions; a partial one has none."""

    @F.pandas_udf("array<double>")
    def mean(flat):
        return flat.map(lambda x: x.reshape(block, -1).mean(0))

    blocks = packed(rows, group, pos, vectors, block, "p").where(F.size("ppos") == block)
    return blocks.select(*(F.col(f"pg{i}").alias(g) for i, g in enumerate(group)), F.col("pblock").alias("block"), *(mean(f"p{n}").alias(n) for n in vectors))


@dataclass(frozen=True)
class Index:
    """Scores by which blocks are chosen: the sum over heads of a query's number and a block's.

    queries names a column of one number a head; a block's number of a head is its mean key times the weights, plus a bias.
    """

    queries: str
    weights: tuple[float, ...]
    bias: float = 0.0

    def scores(self, column: Callable, n: int, m: int, heads: int) -> np.ndarray:
        of_key = column("kk").reshape(m, heads, -1) @ np.array(self.weights) + self.bias
        return column("qi").reshape(n, heads) @ of_key.T


@dataclass(frozen=True)
class BlockScores:
    """How the queries of a cell score and choose blocks."""

    heads: int
    block: int
    scale: float
    digits: int | None
    index: Index | None

    def of(self, column: Callable, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, h, m) scores and those by which blocks are ranked, minus infinity for blocks that are not before a query's."""
        found = dot_scores(column, n, m, self.heads, self.scale)
        ranked = np.repeat(self.index.scores(column, n, m, self.heads)[:, None, :], self.heads, 1) if self.index else found
        if self.digits is not None:
            found, ranked = np.round(found, self.digits), np.round(ranked, self.digits)
        before = column("kpos")[None, :] < column("qpos")[:, None] // self.block
        return tuple(np.where(before[:, None, :], x, -np.inf) for x in (found, ranked))

    def chosen(self, column: Callable, n: int, m: int) -> np.ndarray:
        """The scores, minus infinity also for blocks whose ranking score does not reach the query's threshold."""
        found, ranked = self.of(column, n, m)
        return np.where(ranked >= column("least").reshape(n, self.heads, 1), found, -np.inf)


class BlockCells:
    """Queries with the means of the whole blocks before their own, and how the best of these are chosen."""

    def __init__(self, rows, group, pos, q, k, v, score: BlockScores, size):
        self.group, self.score = group, score
        pooled = pooled_blocks(rows, group, pos, {"k": k, "v": v or k}, score.block)
        self.keys = packed(pooled, group, "block", {"k": "k", "v": "v"}, size, "k")
        self.queries = packed(rows, group, pos, {"q": q} | ({"i": score.index.queries} if score.index else {}), size, "q")
        self.last = F.floor((F.col("qblock") * size + size - 1) / score.block / size)

    def cells(self, queries: DataFrame | None = None) -> DataFrame:
        return cells(self.queries if queries is None else queries, self.keys, self.group, F.lit(0), self.last)

    def thresholds(self, top: int) -> DataFrame:
        """(tg.., tblock, least): for each block of queries the top-th largest of their ranking scores, by query and head.

        The largest `top` scores of two sets of blocks are among the largest of each, so these too merge in any order.
        """
        group, heads, score = self.group, self.score.heads, self.score
        found = self.cells()
        schema = T.StructType([*key_fields(found, group), T.StructField("best", DOUBLES)])
        names = [f.name for f in schema][:-1]

        def best(rows: np.ndarray) -> np.ndarray:
            return -np.sort(-rows, 1)[:, :top]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: dict[tuple, np.ndarray] = {}
                for i in range(batch.num_rows):
                    column = lambda name, i=i: array_of(batch, name, i)
                    n, m = len(column("qpos")), len(column("kpos"))
                    ranked = score.of(column, n, m)[1].reshape(n * heads, m)
                    key = key_of(batch, names, i)
                    held[key] = best(np.concatenate([held[key], ranked], 1) if key in held else np.pad(ranked, ((0, 0), (0, max(0, top - m))), constant_values=-np.inf))
                yield as_batch(schema, [list(c) for c in zip(*((*key, x.ravel()) for key, x in held.items()), strict=True)] if held else [[] for _ in schema])

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, now = None, None
            done = lambda: as_batch(schema, [[k] for k in key] + [[least(now)]])

            def least(rows: np.ndarray) -> np.ndarray:
                """The top-th, or the least of fewer; minus infinity where there is none, as then nothing is seen."""
                some = np.where(rows == -np.inf, np.inf, rows).min(1)
                return np.where(some == np.inf, -np.inf, some)

            for batch in batches:
                for i in range(batch.num_rows):
                    here, rows = key_of(batch, names, i), array_of(batch, "best", i).reshape(-1, top)
                    if key is not None and here != key:
                        yield done()
                        now = None
                    key, now = here, rows if now is None else best(np.concatenate([now, rows], 1))
            if key is not None:
                yield done()

        parts = found.mapInArrow(run, schema)
        dealt = parts.repartition(*names).sortWithinPartitions(*names).mapInArrow(fold, schema)
        return dealt.select(*(F.col(f"qg{i}").alias(f"tg{i}") for i in range(len(group))), F.col("qblock").alias("tblock"), F.col("best").alias("least"))

    def chosen(self, top: int) -> DataFrame:
        """Cells with each query's threshold: blocks whose ranking score reaches it are chosen, ties included."""
        same = F.col("qblock") == F.col("tblock")
        for i in range(len(self.group)):
            same &= F.col(f"qg{i}").eqNullSafe(F.col(f"tg{i}"))
        known = self.queries.join(self.thresholds(top), same).drop("tblock", *(f"tg{i}" for i in range(len(self.group))))
        return self.cells(known)


def chosen_blocks(
    rows: DataFrame, group: list[str], pos: str, q: str, k: str, top: int, block: int, heads: int = 1, scale: float = 1.0,
    sink: float | None = None, digits: int | None = None, index: Index | None = None, size: int = SIZE,
) -> DataFrame:
    """(group.., q, head, k, score, weight): the blocks that each position chooses, with the softmax of their scores.

    Blocks are `block` positions, known by the mean of their keys; a position sees the whole blocks before its own. The
    `top` best are chosen by head and score, or for all heads alike by an index; blocks that tie with the last are
    chosen too. An index chooses, and never weighs. digits rounds scores before they are ranked.
    """
    score = BlockScores(heads, block, scale, digits, index)
    found = BlockCells(rows, group, pos, q, k, None, score, size).chosen(top)
    schema = T.StructType(key_fields(found, group)[:-1] + [T.StructField("q", T.LongType()), T.StructField("head", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column = lambda name, i=i: array_of(batch, name, i)
                scores = score.chosen(column, len(column("qpos")), len(column("kpos")))
                x, h, y = np.nonzero(scores > -np.inf)
                keys = [[batch.column(f"qg{g}")[i].as_py()] * len(x) for g in range(len(group))]
                yield as_batch(schema, [*keys, column("qpos")[x], h, column("kpos")[y], scores[x, h, y]])

    pairs = found.mapInArrow(run, schema)
    pairs = pairs.select(*(F.col(f"qg{i}").alias(g) for i, g in enumerate(group)), "q", "head", "k", "score")
    return attend(pairs, [*group, "head"], 1.0, sink)


def index_divergence(
    rows: DataFrame, group: list[str], pos: str, q: str, k: str, index: Index, block: int, heads: int = 1, scale: float = 1.0, size: int = SIZE
) -> DataFrame:
    """(group.., n, divergence): how far the softmax of the index is from that of the mean scores of all heads.

    The mean Kullback-Leibler divergence over the n positions that have a block before their own. With a the index's and
    b the mean scores of a position's blocks it is the mean of a - b under the softmax of a, less the difference of
    their logs of summed exponentials: five numbers a position, merged like the states of attention.
    """
    score = BlockScores(heads, block, scale, None, index)
    found = BlockCells(rows, group, pos, q, k, None, score, size).cells()
    schema = T.StructType([*key_fields(found, group), T.StructField("qpos", LONGS)] + [T.StructField(n, DOUBLES) for n in ("top", "total", "values")])
    names = [f.name for f in schema][: len(group) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = Folded(len(group))
            for i in range(batch.num_rows):
                column = lambda name, i=i: array_of(batch, name, i)
                real, ranked = score.of(column, len(column("qpos")), len(column("kpos")))
                a, b = ranked[:, 0, :], real.mean(1)
                both = np.stack([a, b], 1)  # two softmaxes: as heads of a state
                under = np.where(both.max(2, initial=-np.inf) == -np.inf, 0.0, both.max(2, initial=-np.inf))
                weights = np.exp(both - under[:, :, None])
                apart = np.where(a > -np.inf, a, 0.0) - np.where(b > -np.inf, b, 0.0)
                sums = np.stack([(weights[:, 0] * apart).sum(1), np.zeros(len(a))], 1)
                folded.add(key_of(batch, names, i), column("qpos"), 0, State(both.max(2, initial=-np.inf), weights.sum(2), sums[:, :, None]))
            out = [(*key, at, s.top.ravel(), s.total.ravel(), s.values.ravel()) for key, (at, held) in folded.held.items() for s in held.values()]
            yield as_batch(schema, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in schema])

    result = T.StructType([*key_fields(found, group)[:-1], T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Folded(len(group))

        def done() -> pa.RecordBatch:
            out = []
            for key, (_, held) in folded.held.items():
                s = held[0]
                has = s.total[:, 0] > 0
                top, total, apart = s.top[has], s.total[has], s.values[has, 0, 0]
                logs = top + np.log(total)
                out.append((*key[:-1], int(has.sum()), float((apart / total[:, 0] - logs[:, 0] + logs[:, 1]).sum())))
            folded.held = {}
            return as_batch(result, [list(c) for c in zip(*out, strict=True)])

        for batch in batches:
            for i in range(batch.num_rows):
                key, at = key_of(batch, names, i), array_of(batch, "qpos", i)
                if folded.held and key not in folded.held:
                    yield done()
                top, total, values = (array_of(batch, n, i).reshape(len(at), 2) for n in ("top", "total", "values"))
                folded.add(key, at, 0, State(top, total, values[:, :, None]))
        if folded.held:
            yield done()

    parts = found.mapInArrow(run, schema).repartition(*names).sortWithinPartitions(*names).mapInArrow(fold, result)
    named = [f"qg{i}" for i in range(len(group))]
    sums = parts.groupBy(*named).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0))
    return sums.select(*(F.col(f"qg{i}").alias(g) for i, g in enumerate(group)), "n", mean.alias("divergence"))


def sparse_attention(
    rows: DataFrame, group: list[str], pos: str, q: str, k: str, v: str, top: int, block: int, window: int, heads: int = 1, scale: float = 1.0,
    sink: float | None = None, digits: int | None = None, index: Index | None = None, size: int = SIZE,
) -> DataFrame:
    """(group.., pos, y): attention to chosen blocks before a position plus attention to the window ahead of it.

    The blocks are those of chosen_blocks(), attended to by their mean values; the window is the position and `window`
    that follow. Each of the two has its own softmax and sink, and both are added. A position of the first block has no
    block before its own, so it gets the window only. The scores of blocks are made twice: once for each query's
    threshold, of which a block holds `top` numbers a query and head, and once to weigh those that reach it.
    """
    score = BlockScores(heads, block, scale, digits, index)
    far = states(BlockCells(rows, group, pos, q, k, v, score, size).chosen(top), group, heads, 0, score.chosen)
    near = band_states(rows, group, pos, q, k, v, heads, 0, window, scale, size, 1)
    return outputs(far.unionByName(near), group, pos, heads, [sink, sink])
