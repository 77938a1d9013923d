import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import arrays, dialogue, experiments, streams, tokens
from corpusloom.plans import manifest


def test_ema_at_each_step_is_the_fold(spark):
    rng = np.random.default_rng(81)
    rows, want = [], {}
    for arm, steps in (("a", range(0, 900)), ("b", range(5, 2000, 37)), (None, [3]), ("d", [0, 10_000, 10_001])):
        mean = None
        for step in steps:
            v = float(rng.normal())
            mean = v if mean is None else 0.8 * mean + 0.2 * v
            rows.append((arm, step, v, "x", 1))
            want[arm, step] = mean
    rows += [("a", 7, None, "x", 1), ("e", None, 1.0, "x", 1)]
    frame = spark.createDataFrame(rows, "arm string, step int, loss double, own string, block int")
    for size in (1, 7, 100, 4096):
        got = {(r.arm, r.step): r.ema for r in experiments.ema_series(frame, "loss", keep=0.8, size=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), size
    last = {r.arm: r.ema for r in experiments.ema(frame, "loss", keep=0.8).collect()}
    assert all(abs(last[a] - want[a, s]) < 1e-12 for a, s in (("a", 899), (None, 3), ("d", 10_001)))
    assert experiments.ema_series(frame.limit(0), "loss").count() == 0


def test_stream_layer_is_a_plain_one(spark):
    rng = np.random.default_rng(82)
    x, weights = rng.normal(size=(30, 4, 6)), rng.normal(size=(6, 6))
    compress, expand, mixing = rng.normal(size=4), rng.normal(size=4), rng.normal(size=(4, 4))
    rows = spark.createDataFrame([(n, v.tolist(), "k") for n, v in enumerate(x)] + [(30, None, "k")], "id int, x array<array<double>>, streams string")
    done = streams.stream_layer(rows, "x", compress.tolist(), expand.tolist(), mixing.tolist(), lambda z: z @ weights)
    assert done.columns == ["id", "x", "streams"]
    got = {r.id: r.streams for r in done.collect()}
    b = streams.doubly_stochastic(mixing)
    assert np.allclose(b.sum(0), 1) and np.allclose(b.sum(1), 1, atol=1e-4) and got[30] is None
    for n, v in enumerate(x):
        z = sum(v[h] / (1 + np.exp(-compress[h])) for h in range(4))
        for c in range(4):
            want = sum(b[h, c] * v[h] for h in range(4)) + (z @ weights) / (1 + np.exp(-expand[c]))
            assert np.allclose(got[n][c], want)
    assert streams.stream_layer(rows.limit(0), "x", compress.tolist(), expand.tolist(), mixing.tolist(), lambda z: z).count() == 0


def test_arrays_of_a_batch(spark):
    rows = [(1, [5, None, 7], [True, False, None]), (2, None, [True]), (3, [], []), (4, [9], [True]), (5, [1, 2, 3, 4], None)]
    frame = spark.createDataFrame(rows, "id int, x array<int>, m array<boolean>").coalesce(1)
    got = frame.select("id", arrays.ahead(F.col("x"), 2).alias("a"), arrays.totals(F.col("x"), 7).alias("t"), arrays.totals(F.col("x")).alias("u"), arrays.where_true(F.col("x"), F.col("m"), -1).alias("w"))
    got = {r.id: r for r in got.collect()}
    assert [got[i].a for i in range(1, 6)] == [[7, None, None], None, [], [None], [3, 4, None, None]]
    assert [tuple(got[i].t) for i in (1, 3, 4)] == [(1, 5, 0), (0, None, None), (1, 9, 0)] and tuple(got[1].u) == (2, 12, 14)
    assert [got[i].w for i in range(1, 6)] == [[5, -1, -1], None, [], [9], None]
    text = spark.createDataFrame([("aé𝄞",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(arrays.code_points(F.col("t"))).collect()] == [[97, 233, 0x1D11E], [], None]


def test_lookup_of_few_and_many_vectors(spark):
    said = spark.createDataFrame([(n, n % 3 if n % 5 else 99, {"k": n}) for n in range(40)] + [(40, None, None)], "n int, tok int, extra map<string,int>")
    vectors = spark.createDataFrame([(t, [float(t)]) for t in range(3)], "tok int, x array<double>")
    for sent in (10_000, 1):
        got = tokens.lookup(said, vectors, sent_rows=sent)
        assert got.columns == ["n", "tok", "extra", "x"]
        assert {r.n: r.x for r in got.collect()} == {n: [float(n % 3)] if n % 5 and n < 40 else None for n in range(41)} and got.count() == 41


def test_shapes_of_ones_own(spark):
    rows = spark.createDataFrame([("q", "a"), (None, "b")], "ask string, say string")
    own = lambda r: dialogue.single_turn(r["ask"], r["say"])
    dialogue.register_shape("asked", own, replace=True)
    with pytest.raises(ValueError):
        dialogue.register_shape("asked", own)
    try:
        named, given = (dialogue.to_blocks(rows, s).select("ask", "block").collect() for s in ("asked", own))
    finally:
        del dialogue.SHAPES["asked"]
    assert named == given and "a" in named[0].block
    with pytest.raises(KeyError):
        dialogue.to_blocks(rows, "asked")


def test_dataset_manifest(spark):
    docs = spark.createDataFrame([("train", "ab"), ("train", "c"), ("val", "def")], "split string, text string")
    files = spark.createDataFrame([("b.txt", 10, "y"), ("a.txt", 5, "x")], "file string, size_bytes long, sha256 string")
    row = manifest.dataset_manifest(docs, files).first()
    assert [(s.split, s.n_docs, s.n_chars) for s in row.splits] == [("train", 2, 3), ("val", 1, 3)]
    assert [(f.file, f.size_bytes, f.sha256) for f in row.files] == [("a.txt", 5, "x"), ("b.txt", 10, "y")] and row.size_bytes == 15
