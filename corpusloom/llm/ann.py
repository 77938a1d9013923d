"""Nearest neighbours by inner product: multi-index hashing of learned rotated binary codes, reranked on floats."""

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

#: Vectors that the codes are fitted on, and those of them that act as queries to set the radius.
FIT_ROWS, FIT_QUERIES = 4096, 256
#: Share of true neighbours in the sample that must lie within the first Hamming radius.
WITHIN = 0.96
#: Codes are long, so that few vectors that are no neighbours lie within the radius of their neighbours.
SUBSTRINGS, SUBSTRING_BITS = 32, 16
#: Vectors in one block of the index, and queries in one block of queries; a task holds one of each.
INDEX_BLOCK, QUERY_BLOCK = 16384, 8192
#: Lengths of codes, in substrings, by which buckets may be looked up; the most bits of a substring that may then differ,
#: and the most buckets and codes in them, as a share of all rows, that a query may take on average.
LOOKED_UP, MOST_REACH, MOST_VISITED = (4, 6, 8, 12, 16), 3, 0.05
#: How much of the way to the longest distance the radius grows for queries that found fewer than k.
GROWTH = 0.25


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) rows that can take part: an id, a vector without null or non-finite parts, and not all zero."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))
    return rows.where(F.col("id").isNotNull() & finite & F.exists("x", lambda v: v != 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


@dataclass
class Codes:
    """Binary codes: signs of the centred vector along learned directions.

    Vectors are first scaled by the largest norm and given one more part that makes them of unit length, so
    that the largest inner product with a query is the smallest angle to it.
    """

    largest: float
    mean: np.ndarray
    directions: np.ndarray
    radius: int
    #: For codes of fewer substrings: radius, buckets that a query looks up, and the share of the codes that are in them.
    shorter: dict[int, tuple[int, int, float]] = field(default_factory=dict)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))])
        x = x / self.largest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def code(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        bits = (self.lifted(x, query) - self.mean) @ self.directions > 0
        packed = np.packbits(bits, axis=1, bitorder="little")
        return np.ascontiguousarray(packed).view("<u2")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes, which are rows of substrings."""
    kind = np.uint64 if a.shape[-1] % 4 == 0 else np.uint32 if a.shape[-1] % 2 == 0 else np.uint16
    words = np.ascontiguousarray(a).view(kind) ^ np.ascontiguousarray(b).view(kind)
    return np.bitwise_count(words).sum(-1, dtype=np.int64)


def fit(sample: np.ndarray, largest: float, k: int, bits: int = SUBSTRINGS * SUBSTRING_BITS, rounds: int = 40) -> Codes:
    """Principal directions of the sample, turned by the rotation that brings them closest to their signs.

    With fewer dimensions than bits the directions are repeated under further random rotations. The radius
    is the Hamming distance within which WITHIN of the sample queries' k true neighbours in the sample lie; k is
    as much smaller than what is asked for as the sample is smaller than the table.
    """
    codes = Codes(largest, np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, bits)), bits)
    lifted = codes.lifted(sample, query=False)
    codes.mean = lifted.mean(0)
    centred = lifted - codes.mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    projected, parts, random = centred @ axes, [], np.random.default_rng(3)
    for begin in range(0, bits, axes.shape[1]):
        turn, _ = np.linalg.qr(random.standard_normal((axes.shape[1], axes.shape[1])))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        parts.append((axes @ turn)[:, : bits - begin])
    codes.directions = np.hstack(parts)
    queries = sample[:FIT_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if near.size:
        asked, known = codes.code(queries, True), codes.code(sample)
        found = np.array([distance(known[some], one) for one, some in zip(asked, near, strict=True)])
        codes.radius = int(np.quantile(found, WITHIN, method="higher"))
        for m in LOOKED_UP:
            table, part = MultiIndex(known[:, :m]), asked[:, :m]
            found = np.array([distance(known[some, :m], one) for one, some in zip(part, near, strict=True)])
            radius = int(np.quantile(found, WITHIN, method="higher"))
            reaches = reaches_of(radius, m)
            if max(reaches) <= MOST_REACH:
                visited = sum(int(table.held(one, s, reach)) for one in part for s, reach in enumerate(reaches))
                codes.shorter[m] = radius, sum(len(flips(r)) for r in reaches if r >= 0), visited / len(part) / len(sample)
    return codes


def lookups(codes: Codes, n_rows: int) -> int | None:
    """Substrings of the code by which a query visits fewest buckets and codes, if these are few; None if none is good."""
    cost = {m: buckets + share * n_rows for m, (_, buckets, share) in codes.shorter.items()}
    best = min(cost, key=cost.get, default=None)
    return best if best is not None and cost[best] <= MOST_VISITED * n_rows else None


def reaches_of(radius: int, substrings: int) -> list[int]:
    """Bits by which each substring of a code within the radius may differ, in the one where it differs least; -1: none."""
    each, more = divmod(radius, substrings)
    return [min(each - (s > more), SUBSTRING_BITS) for s in range(substrings)]


@functools.cache
def flips(radius: int) -> np.ndarray:
    """All substring values within a Hamming radius of 0."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(SUBSTRING_BITS), r)], dtype=np.uint16)


class MultiIndex:
    """One directory of buckets for each substring of the codes.

    A code within radius r of a query agrees with it in some substring to within r // SUBSTRINGS bits, and
    to within one bit fewer in those after the first r % SUBSTRINGS + 1: probing these buckets finds all.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for s in range(codes.shape[1]):
            values, number, sizes = np.unique(codes[:, s], return_inverse=True, return_counts=True)
            self.tables.append((values, number, np.argsort(number, kind="stable"), np.concatenate([[0], sizes.cumsum()])))

    def probe(self, seen: np.ndarray, s: int, part: np.uint16, reach: int) -> None:
        """Mark the codes in the buckets within reach of one substring of a query.

        Where few bucket numbers are so near they are looked up; else the buckets that hold anything are gone through.
        """
        values, number, order, bounds = self.tables[s]
        if comb(SUBSTRING_BITS, reach) * 16 > len(values):
            seen |= (np.bitwise_count(values ^ part) <= reach)[number]
            return
        wanted = flips(reach) ^ part
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        for i in at[values[at] == wanted]:
            seen[order[bounds[i] : bounds[i + 1]]] = True

    def held(self, query: np.ndarray, s: int, reach: int) -> int:
        """How many codes are in the buckets within reach of a substring of a query."""
        values, _, _, bounds = self.tables[s]
        return int(np.diff(bounds)[np.bitwise_count(values ^ query[s]) <= reach].sum())

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius, each once."""
        seen = np.zeros(len(self.codes), dtype=bool)
        for s, reach in enumerate(reaches_of(radius, self.codes.shape[1])):
            if reach >= 0:
                self.probe(seen, s, query[s], reach)
        found = np.flatnonzero(seen)
        return found[distance(self.codes[found], query) <= radius]


def search(queries: pd.DataFrame, index: pd.DataFrame, codes: Codes, radius: int, k: int) -> tuple[pd.DataFrame, list[int]]:
    """Each query's k best rows within the radius in one index block, (query_id, id, score), and how many rows lie within it."""
    x, ids = matrix(index["x"]), index["id"].to_numpy()
    table = MultiIndex(codes.code(x))
    q = matrix(queries["x"])
    out, sizes = [], []
    for query_id, vector, code in zip(queries["id"].to_numpy(), q, codes.code(q, True), strict=True):
        found = table.within(code, radius)
        found = found[ids[found] != query_id]
        n = len(found)
        sizes.append(n)
        scores = (x[found] * vector).sum(1)  # row by row, so equal vectors get equal scores
        if n > k:
            least = np.partition(scores, n - k)[n - k]
            found, scores = found[scores >= least], scores[scores >= least]
        best = np.lexsort((ids[found], -scores))[:k]
        out.append((ids[found[best]], scores[best]))
    rows = pd.DataFrame({
        "query_id": np.repeat(queries["id"].to_numpy(), [len(i) for i, _ in out]),
        "id": np.concatenate([ids[:0], *(i for i, _ in out)]),
        "score": np.concatenate([np.zeros(0), *(v for _, v in out)]),
    })
    return rows, sizes


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest inner product found for each query.

    is_query is a condition on the id column. The codes and the first radius are fitted on the FIT_ROWS vectors
    whose ids hash lowest; every row is indexed. Where a code of few substrings tells neighbours from others, so that a
    query visits few buckets with few codes in them (lookups()), the index is a table by substring and bucket, shuffled
    once, and the queries' buckets are joined to it (best_by_lookup()). Else nothing is spared by looking up,
    and a long code is better, of which few others lie within the radius: queries and index are dealt into blocks by a
    hash of their ids; a task holds one block of each, indexes the codes, probes them and returns k rows a query. So
    neither side is ever whole in one place. Queries that find fewer than k rows (or than there are) within the radius
    search again in blocks with a larger one, until it spans the whole code.

    Vectors that are null, zero, or hold null or non-finite parts take no part, nor do rows without an id or
    of another dimension than most. A query's own id is never among its neighbours; rows that repeat an id
    are one row, the one of the lesser vector. Ties go to the smaller id. Too few candidates give all of
    them; an empty table or one without queries gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(
        F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    ).alias("largest")).orderBy(F.desc("n"), "d").first()
    id_type = vectors.schema[id_col].dataType.simpleString()
    result = f"query_id {id_type}, id {id_type}, score double"
    shown = ("query_id", "rank", F.col("id").alias(id_col), "score")
    if usual is None:
        return spark.createDataFrame([], result).withColumn("rank", F.lit(1)).select(*shown)
    rows = rows.where(F.size("x") == usual["d"]).groupBy("id").agg(F.min("x").alias("x"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas().sort_values("id")
    order = np.random.default_rng(1).permutation(len(sample))
    n_rows = rows.count()
    near = -(-k * len(sample) // n_rows)  # as far in the sample as the k nearest of all rows
    codes = spark.sparkContext.broadcast(fit(matrix(sample["x"])[order], usual["largest"], near))
    queries = rows.withColumn(id_col, F.col("id")).where(is_query).select("id", "x")
    left = queries.count()
    enough = min(k, n_rows - 1)
    bits, radius, done = SUBSTRINGS * SUBSTRING_BITS, codes.value.radius, []
    looked_up = lookups(codes.value, n_rows) if left else None
    while True:
        if looked_up:
            found = best_by_lookup(queries, rows, codes, looked_up, k)
        else:
            found = best_in_blocks(queries, rows, codes, radius, k, n_rows, left, index_block, query_block, result)
        found = materialise(found, "nearest")
        if radius >= bits or not left:
            done.append(found)
            break
        sizes = found.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
        full = sizes.where(F.col("_n") >= enough)
        done.append(found.join(full, F.col("query_id") == F.col("_q"), "left_semi"))
        queries = materialise(queries.join(full, F.col("id") == F.col("_q"), "left_anti"), "queries")
        left = queries.count()
        if not left:
            break
        if not looked_up:
            radius += max(1, int((bits - radius) * GROWTH))
        looked_up = None
    return functools.reduce(DataFrame.union, done).select(*shown)


def coded(rows: DataFrame, codes, substrings: int, query: bool) -> DataFrame:
    """(id, x, part, bucket, code): each row once for each substring of its code, or for a query once for each bucket near it."""
    reaches = reaches_of(codes.value.shorter[substrings][0], substrings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            code = codes.value.code(matrix(batch["x"]), query)[:, :substrings]
            packed = [c.tobytes() for c in np.ascontiguousarray(code)]
            for s, reach in enumerate(reaches):
                if reach < 0:
                    continue
                near = flips(reach if query else 0)
                step = max(1, 100_000 // len(near))
                for a in range(0, len(batch), step):
                    at = np.repeat(np.arange(a, min(len(batch), a + step)), len(near))
                    buckets = (code[a : a + step, s, None] ^ near[None, :]).ravel().astype(np.int32)
                    yield pd.DataFrame({"id": batch["id"].to_numpy()[at], "part": np.int32(s), "bucket": buckets, "code": [packed[i] for i in at.tolist()]})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, part int, bucket int, code binary")


def best_by_lookup(queries: DataFrame, rows: DataFrame, codes, substrings: int, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows within the radius of each query, by buckets of the codes' substrings.

    Of equal vectors one stands for all: their k + 1 least ids are all that any query can need of them. A pair is taken
    from the first substring that brings it together, if the whole codes are within the radius, and is then scored on floats.
    """
    radius = codes.value.shorter[substrings][0]
    reaches = reaches_of(radius, substrings)
    least = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    numbered = rows.withColumn("nth", F.pmod(F.xxhash64("id"), F.lit(64)))  # equal vectors may be very many
    some = numbered.groupBy("x", "nth").agg(least.alias("ids")).groupBy("x")
    kinds = materialise(some.agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).select(F.get("ids", F.lit(0)).alias("id"), "x", "ids"), "kinds")
    index = coded(kinds, codes, substrings, query=False)
    probes = coded(queries, codes, substrings, query=True).select(F.col("id").alias("query_id"), F.col("part").alias("_part"), F.col("bucket").alias("_bucket"), F.col("code").alias("asked"))

    @F.pandas_udf("boolean")
    def first_within(part: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        one, other = (np.frombuffer(b"".join(x), dtype="<u2").reshape(-1, substrings) for x in (a, b))
        meets = np.bitwise_count(one ^ other) <= np.array(reaches)
        return pd.Series((meets.argmax(1) == part.to_numpy()) & (distance(one, other) <= radius))

    met = probes.join(index, (F.col("part") == F.col("_part")) & (F.col("bucket") == F.col("_bucket")))
    pairs = met.where(first_within("part", "asked", "code")).select("query_id", "id")

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((matrix(a) * matrix(b)).sum(1))

    asked = queries.select(F.col("id").alias("_q"), F.col("x").alias("q"))
    held = kinds.select(F.col("id").alias("_id"), "x", "ids")
    scored = pairs.join(asked, F.col("query_id") == F.col("_q")).join(held, F.col("id") == F.col("_id"))
    scored = scored.select("query_id", product("x", "q").alias("score"), F.explode("ids").alias("id")).where("id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", "rank")


def best_in_blocks(queries, rows, codes, radius, k, n_rows, n_queries, index_block, query_block, result) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows within the radius of each query, over all blocks."""
    n_index, n_query = max(1, -(-n_rows // index_block)), max(1, -(-n_queries // query_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "x", block(n_query).alias("q"), across(n_index).alias("b")).groupBy("q", "b")
    right = rows.select("id", "x", block(n_index).alias("b"), across(n_query).alias("q")).groupBy("q", "b")

    def compare(some_queries: pd.DataFrame, some_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(some_queries) or not len(some_rows):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return search(some_queries, some_rows, codes.value, radius, k)[0]

    partial = left.cogroup(right).applyInPandas(compare, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
