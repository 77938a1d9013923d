import random
from collections import Counter

from corpusloom.llm import suffix_dedup


def starts(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]


def test_transform_finds_repeated_strings():
    random.seed(12)
    for _ in range(150):
        length = random.choice([1, 5, 9, 20, 40])
        texts = ["".join(random.choices("abc", k=random.randint(0, 60))).encode() for _ in range(random.randint(1, 8))]
        texts += [texts[0][3:] + b"xyz", b"qq" + texts[-1]] * random.randint(0, 1)
        got = suffix_dedup.repeated_starts(texts, length)
        assert [g.tolist() for g in got] == starts(texts, length)


def corpus():
    random.seed(13)
    make = lambda n: "".join(random.choices("abcdefgh é", k=n))
    passage, line = make(160), make(50)
    docs = [make(random.randint(0, 400)) for _ in range(60)]
    docs += [make(random.randint(0, 80)) + passage + make(random.randint(0, 80)) for _ in range(40)]
    docs += [make(30) + line + make(30) for _ in range(40)] + ["ab" * 150, "ab" * 100 + "x", None, "", "é" * 90, "short"]
    return docs + [docs[70], docs[70], docs[3]]


def removed(docs, length):
    raw = [(d or "").encode() for d in docs]
    out = []
    for t, at in zip(raw, starts(raw, length), strict=True):
        cover = [False] * (len(t) + 1)
        for i in at:
            cover[i : i + length] = [True] * length
        spans = [(i, next(j for j in range(i, len(t) + 1) if not cover[j])) for i in range(len(t)) if cover[i] and (i == 0 or not cover[i - 1])]
        out.append((spans, bytes(c for c, x in zip(t, cover, strict=False) if not x)))
    return out


def test_removal_is_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i % 100, t, n) for n, (i, t) in enumerate(enumerate(docs))], "_ref long, text string, row long")
    for most in (1 << 19, 300, 1):  # from 300 anchors on are split, down to single strings where it is 1
        got = suffix_dedup.remove_repeats(frame, length=60, gram=12, crowded=most)
        assert got.columns == ["_ref", "text", "row", "repeats"]
        found = {r.row: ([tuple(s) for s in r.repeats.spans], bytes(r.repeats.kept)) for r in got.collect()}
        assert found == dict(enumerate(removed(docs, 60)))


def test_anchor_of_a_segment_is_found_again():
    random.seed(15)
    raw = "".join(random.choices("abcd", k=4000)).encode()
    for key, _, lo, hi in zip(*(a.tolist() for a in suffix_dedup.anchors(raw, 60, 12)), strict=True):
        segment = raw[lo : hi + 60]
        at = suffix_dedup.anchor_of(segment, 60, 12)
        sums = suffix_dedup.prefix_sums(suffix_dedup.np.frombuffer(segment, dtype="u1"))
        here = suffix_dedup.np.array([at])
        assert int(suffix_dedup.hashes(sums, here, here + 12)[0].view("i8")) == suffix_dedup.np.uint64(key).view("i8")


def test_periodic_text_has_no_more_rows_than_other_text(spark):
    for raw in (b"a" * 300_000, b"=-" * 150_000, b"0123456789" * 30_000, b"\n \n" * 100_000):
        assert len(suffix_dedup.anchors(raw, 200, 32)[0]) < len(raw) / 60
    docs = ["x" * 5000, "=-" * 900 + "end", "ab" * 40 + "tail of another kind " * 3, "begin" + "x" * 250, "-=" * 300, "y" * 59, "z" * 60, "z" * 61]
    frame = spark.createDataFrame(list(enumerate(docs)), "row long, text string")
    got = suffix_dedup.remove_repeats(frame, length=60, gram=12)
    found = {r.row: ([tuple(s) for s in r.repeats.spans], bytes(r.repeats.kept)) for r in got.collect()}
    assert found == dict(enumerate(removed(docs, 60)))


def test_long_text_is_looked_at_in_chunks(monkeypatch):
    random.seed(14)
    raw = "".join(random.choices("abcd", k=3000)).encode()
    one = suffix_dedup.anchors(raw, 60, 12)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    cut = suffix_dedup.anchors(raw, 60, 12)
    cover = lambda parts: [p for lo, hi in zip(parts[2], parts[3], strict=True) for p in range(lo, hi + 1)]
    assert cover(one) == cover(cut) == list(range(3000 - 60 + 1))
    assert set(one[0].tolist()) == set(cut[0].tolist())


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
