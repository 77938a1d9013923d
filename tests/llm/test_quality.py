import random
import re
import zlib
from collections import Counter

import numpy as np

from corpusloom.llm import quality
from corpusloom.llm.queries import queries
from corpusloom.llm.tables import read_table

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    got = queries()["op2_quality"](spark, FOLDER).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    known = got[got["held_out"]].merge(read_table(spark, FOLDER, "labels").toPandas(), on="doc_id")
    assert (known["predicted"] == known["quality"]).mean() > 0.9
    good, bad = known[known["quality"] == 1]["score"].to_numpy(), known[known["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    y = np.where(np.array([r.min() for r in rows]) < 4, 1, -1)
    w, b = quality.dual_coordinate_descent(rows, np.ones(30), y, c=1.0, epochs=300)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)
    x[:, 30] = 1

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    here = loss(np.append(w, b))
    assert all(here <= loss(np.append(w, b) + d) + 1e-3 for d in rng.normal(scale=0.05, size=(500, 31)))


def test_features_of_odd_texts():
    assert len(quality.features(None)) == len(quality.features("")) == 0
    assert len(quality.features("a")) == 1
    whole = "word " * 300000  # more than a chunk
    assert set(quality.features("word word word word ")) == set(quality.features(whole))
    assert set(quality.bucket(np.array([0], dtype=np.uint64), 2)) <= set(quality.features("x x"))


def plain_features(text):
    raw = (text or "").encode()
    one = lambda code, kind: int(quality.bucket(np.array([code % 2**64], dtype=np.uint64), kind)[0])
    out = {one(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2], 0) for i in range(len(raw) - 2)}
    step, mix = int(quality.STEP), int(quality.MIX)
    words = [sum(c * pow(step, i, 2**64) for i, c in enumerate(w)) % 2**64 for w in re.findall(rb"[!-\xff]+", raw)]
    out |= {one(w, 1) for w in words}
    out |= {one(0 if a == b else b * step + a * mix, 2) for a, b in zip(words, words[1:], strict=False)}
    for n in (3, 4):
        out |= {one(0, n) for i in range(len(words) - n + 1) if len(set(words[i : i + n])) == 1}
    return sorted(out)


def test_features_are_those_of_a_plain_version_at_every_chunk_size(monkeypatch):
    rng = random.Random(7)
    texts = ["", "a", "é é", " x ", "word", *("".join(rng.choices("ab é\n", k=rng.randint(0, 60))) for _ in range(60))]
    for size in (1 << 20, 1, 2, 3, 7, 16):
        monkeypatch.setattr(quality, "CHUNK", size)
        for t in texts:
            assert quality.features(t).tolist() == plain_features(t), (size, t)


def test_query_is_a_plain_version(spark):
    rng = random.Random(8)
    good, bad = "the cat sat on a mat".split(), "buy now cheap pills win".split()
    docs = [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(3, 12)))) for i in range(120)]
    labels = [(i, int(i % 3 > 0)) for i in range(100)]
    got = quality.classify(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ).collect()
    learn = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = dict(docs)
    sizes = [sum(y == c for _, y in learn) for c in (0, 1)]
    counts = [Counter(f for i, y in learn if y == c for f in plain_features(texts[i])) for c in (0, 1)]
    scale = {f: np.log((counts[1][f] + 1) / (sizes[1] + 2)) - np.log((counts[0][f] + 1) / (sizes[0] + 2)) for f in counts[0] | counts[1]}
    dense = np.zeros(quality.FEATURES)
    dense[list(scale)] = list(scale.values())
    rows = [(np.array(plain_features(texts[i])), 2 * y - 1) for i, y in sorted(learn)]
    train, later = [r for n, r in enumerate(rows) if n % 4], rows[::4]
    w, b = quality.dual_coordinate_descent([x for x, _ in train], dense, np.array([y for _, y in train]))
    margin = lambda x: w[x] @ dense[x] / (np.sqrt((dense[x] ** 2).sum()) or 1) + b
    y = np.array([v for _, v in later])
    slope, shift = quality.platt(np.array([margin(x) for x, _ in later]), y)
    shift += np.log(sizes[1] / sizes[0]) - np.log(sum(v > 0 for _, v in rows) / sum(v <= 0 for _, v in rows))
    for r in got:
        want = 1 / (1 + np.exp(-(slope * margin(np.array(plain_features(r.text), dtype=int)) + shift)))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_fit_is_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2, f"word{i % 500} and word{i % 7}") for i in range(9_000)], "doc long, text string")
    known = spark.createDataFrame([(0, 0), (1, 1)], "id long, label int")
    assert len(quality.fit_sample(docs, known, 10)) == 2
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(400)], "doc long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(400)], "id long, label int")
    assert quality.fit_sample(docs, known, 60)["label"].value_counts().to_dict() == {0: 60, 1: 60}
    monkeypatch.setattr(quality, "FIT_BYTES", 20_000)
    rows = quality.fit_sample(docs, known, 60)
    assert rows.groupby("label")["found"].apply(lambda x: x.map(len).sum()).between(15_000, 20_000).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "text", 5), (1, None, 5)], "doc_id long, text string, label int")
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 0), (1, 1, 0), (9, 1, 1), (None, 1, 1), (2, None, 1)]):
        given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = quality.classify(docs, given).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), given).count() == 0
