import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann
from corpusloom.llm.queries import queries
from corpusloom.llm.tables import read_table

ROOT = "/root/testdata/"


def brute(rows, queries, k):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in rows:
        if i in queries:
            scores = [((x[n] * np.array(v)).sum(), j) for n, j in enumerate(ids) if j != i]
            out[i] = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, folder):
    rows = [(r.vec_id, list(r.embedding)) for r in read_table(spark, ROOT + folder, "embeddings").collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = queries()["op10_nearest"](spark, ROOT + folder).toPandas()
    by_id = dict(rows)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in part["vec_id"].tolist()
        pairs = list(zip(-part["score"], part["vec_id"], strict=True))
        assert pairs == sorted(pairs)
        for v, s in zip(part["vec_id"], part["score"], strict=True):
            assert abs(s - float(np.dot(np.float64(by_id[q]), np.float64(by_id[v])))) < 1e-12
        hits += len(set(part["vec_id"]) & {j for _, j in want[q]})
    assert set(got["query_id"]) == set(want) and hits >= 0.9 * 20 * len(want)


def test_few_rows_are_candidates(spark):
    rows = read_table(spark, ROOT + "sf0.1", "embeddings").toPandas().rename(columns={"vec_id": "id", "embedding": "x"})
    codes = ann.fit(ann.matrix(rows["x"]), 1.0, 20)
    _, sizes = ann.search(rows[rows["id"] % 20 == 0], rows, codes, codes.radius, 20)
    assert np.mean(sizes) <= 0.05 * len(rows)


def test_index_finds_every_code_within_a_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, (20, ann.SUBSTRINGS), dtype=np.uint16)
    bits = ann.SUBSTRINGS * ann.SUBSTRING_BITS
    codes = []
    for b in base:
        for _ in range(20):
            c = np.unpackbits(b.view(np.uint8))
            c[rng.choice(bits, rng.integers(0, 150), replace=False)] ^= 1
            codes.append(np.packbits(c).view(np.uint16))
    codes = np.array(codes)
    table = ann.MultiIndex(codes)
    for radius in (0, 1, 3, 31, 32, 40, 75, 100, 215, bits):
        for q in base[:5]:
            assert table.within(q, radius).tolist() == np.flatnonzero(ann.distance(codes, q) <= radius).tolist()


def clustered(n=12_000, clusters=600, dim=32):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((clusters, dim))
    x = centres[np.arange(n) % clusters] + 0.04 * rng.standard_normal((n, dim))
    x[5:40] = x[4]  # equal vectors, more than k
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def test_buckets_are_looked_up_where_vectors_are_clustered(spark, monkeypatch):
    """Few codes are visited, no block meets another, and the neighbours are found."""
    x = clustered()
    codes = ann.fit(x[:4096], 1.0, 4)
    m = ann.lookups(codes, len(x))
    assert m is not None
    table = ann.MultiIndex(codes.code(x)[:, :m])
    radius, buckets, _ = codes.shorter[m]
    visited = [sum(table.held(c, s, r) for s, r in enumerate(ann.reaches_of(radius, m))) for c in codes.code(x[::400], True)[:, :m]]
    assert np.mean(visited) + buckets <= 0.1 * len(x)
    monkeypatch.setattr(ann, "best_in_blocks", None)  # would fail
    frame = spark.createDataFrame([(i, v.tolist(), "z") for i, v in enumerate(x)], "vec_id long, embedding array<double>, part string")
    got = ann.nearest(frame, F.col("vec_id") % 400 == 0, k=10).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -scores))[:10]
        part = part.sort_values("rank")
        assert np.allclose(part["score"], scores[part["vec_id"]]) and (np.diff(part["score"]) <= 0).all()
        hits += len(set(part["vec_id"]) & set(want.tolist()))
    assert len(got) == 300 and hits >= 0.9 * 300


def test_equal_vectors_stand_for_each_other(spark):
    x = clustered()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("vec_id").isin(7, 39), k=12).toPandas().sort_values(["query_id", "rank"])
    assert got["vec_id"].tolist() == [4, 5, 6, *range(8, 17), *range(4, 16)]


def test_several_blocks_find_what_one_does(spark):
    """At sf0.1 nothing is spared by looking up, so blocks are searched; recall holds over many of them."""
    table = read_table(spark, ROOT + "sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = ann.nearest(table, F.col("vec_id") % 20 == 0, index_block=300, query_block=40).toPandas()
    hits = sum(len(set(part["vec_id"]) & {j for _, j in want[q]}) for q, part in got.groupby("query_id"))
    assert len(got) == 20 * len(want) and hits >= 0.9 * len(got)


def test_radius_grows_until_enough_are_found(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(20 * i, (-5 * rng.random(8)).tolist()) for i in range(4, 6)]  # far from all others
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitted = ann.fit

    def narrow(*args):
        codes = fitted(*args)
        codes.radius = 3
        return codes

    monkeypatch.setattr(ann, "fit", narrow)
    got = ann.nearest(frame, F.col("vec_id") % 20 == 0, k=5).toPandas()
    assert got.groupby("query_id")["rank"].apply(list).tolist() == [[1, 2, 3, 4, 5]] * 5


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.5]), (20, [-1.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    rows += [(8, [1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (1, [1.0, 0.0]), (9, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, id string")
    for blocks in (16384, 2):
        got = ann.nearest(frame, F.col("vec_id") % 20 == 0, k=3, index_block=blocks, query_block=blocks).collect()
        good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.5]), (20, [-1.0, 3.0]), (9, [1.0, 0.0])]
        want = brute(good, {0, 20}, 3)
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(q, n + 1, j, s) for q in (0, 20) for n, (s, j) in enumerate(want[q])]
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
