import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup

DOCS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "é" * 5000), (7, "é" * 5000), (None, "a"), (3, "a"), (8, "c"), (8, "d")]


def expected(docs, keep):
    texts = {}
    for i, t in docs:
        texts.setdefault(t or "", []).append(i)
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in texts.items()}
    return sorted(
        ((i, best[t or ""], len(texts[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs),
        key=repr,
    )


def frame(spark, docs=DOCS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, keep_id string, _h int")


def test_groups(spark):
    for keep in ("min", "max"):
        got = exact_dedup.exact_groups(frame(spark), keep=keep).collect()
        assert sorted((tuple(r) for r in got), key=repr) == expected(DOCS, {"min": min, "max": max}[keep])


def test_colliding_hashes_are_kept_apart(spark):
    same = lambda text: F.lit(b"\0" * 16)
    got = exact_dedup.exact_groups(frame(spark), keep="max", hash_of=same).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(DOCS, max)


def test_drop(spark):
    got = exact_dedup.drop_exact(frame(spark), keep="max")
    assert got.columns == ["doc_id", "text", "keep_id", "_h"]
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(2, "b"), (3, "a"), (5, ""), (7, "é" * 5000), (8, "c"), (8, "d")]


def test_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact(frame(spark, [])).count() == 0
