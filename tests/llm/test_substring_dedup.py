import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import queries, substring_dedup

FOLDER = "/root/testdata/sf0.001"


def starts(texts, length):
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if seen[tuple(t[i : i + length])] > 1] for t in texts]


def removed(docs, length):
    words = [(d or "").encode().split() for d in docs]
    out = []
    for t, at in zip(words, starts(words, length), strict=True):
        cover = [False] * (len(t) + 1)
        for i in at:
            cover[i : i + length] = [True] * length
        spans = [(i, next(j for j in range(i, len(t) + 1) if not cover[j])) for i in range(len(t)) if cover[i] and (i == 0 or not cover[i - 1])]
        out.append((len(t), spans, b" ".join(w for w, x in zip(t, cover, strict=False) if not x).decode()))
    return out


def test_trees_find_repeated_strings():
    random.seed(31)
    for _ in range(200):
        length = random.choice([1, 2, 5, 9, 20])
        texts = [random.choices(["a", "b", "cc"], k=random.randint(0, 60)) for _ in range(random.randint(1, 8))]
        texts += [texts[0][3:] + ["x"], ["q", *texts[-1]]] * random.randint(0, 1)
        got = substring_dedup.leaf_parents([" ".join(t).encode() for t in texts], length)
        assert [g.tolist() for g, _ in got] == starts(texts, length)
        for t, (at, depths) in zip(texts, got, strict=True):  # a parent is as deep as the string is repeated
            for i, d in zip(at.tolist(), depths.tolist(), strict=True):
                some = lambda n: sum(u[j : j + n] == t[i : i + n] for u in texts for j in range(len(u) - n + 1))  # noqa: B023, E731
                assert some(d) > 1 and (i + d == len(t) or some(d + 1) == 1)


def corpus():
    random.seed(32)
    word = lambda: "".join(random.choices("abcé", k=random.randint(1, 3)))
    make = lambda n: [word() for _ in range(n)]
    passage, line = make(40), make(9)
    docs = [make(random.randint(0, 90)) for _ in range(60)]
    docs += [make(random.randint(0, 20)) + passage + make(random.randint(0, 20)) for _ in range(40)]
    docs += [make(8) + line + make(8) for _ in range(40)]
    docs += [["a", "b"] * 60, ["a", "b"] * 40 + ["x"], ["a"] * 500, ["a"] * 13, passage * 2, make(3) + ["a"] * 30]
    texts = [random.choice([" ", "\n", "\t ", "\x0b"]).join(d) for d in docs]
    texts += [texts[70], texts[70].replace(" ", "  ") + "\n", texts[3], None, "", " \n ", "a\xa0b", "x" * 300, "b c " * 5]
    return texts


def test_removal_is_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i % 100, t, n) for n, (i, t) in enumerate(enumerate(docs))], "_ref long, text string, row long")
    for most in (1 << 18, 2000, 1):  # below the default groups are split by longer prefixes, and where it is 1 as far as that goes
        got = substring_dedup.remove_repeats(frame, length=12, gram=3, crowded=most)
        assert got.columns == ["_ref", "text", "row", "repeats"]
        found = {r.row: (r.repeats.n_words, [tuple(s) for s in r.repeats.spans], r.repeats.kept) for r in got.collect()}
        assert found == dict(enumerate(removed(docs, 12)))


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = {
        r.doc_id: (n, sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest())
        for r, (n, spans, kept) in zip(docs, removed([r.text for r in docs], 35), strict=True)
    }
    got = queries.op11_substring_dedup(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected
    assert len(got) == len(docs)


def test_a_text_that_repeats_itself_gives_each_window_once():
    words = substring_dedup.word_hashes(b"a " * 100_000 + b"b c d " * 50_000)
    _, _, lo, hi, _ = substring_dedup.anchors(words, 35, 8)
    assert (hi - lo + 1).sum() == 1 + 34 + 3


def test_long_text_is_looked_at_in_chunks(monkeypatch):
    random.seed(33)
    raw = " ".join(random.choices(["a", "b", "c", "d" * 70], k=3000)).encode()
    one = substring_dedup.word_hashes(raw)
    before = substring_dedup.anchors(one, 35, 8)
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    assert np.array_equal(substring_dedup.word_hashes(raw) == one, np.array([len(w) <= 50 for w in raw.split()]))
    after = substring_dedup.anchors(one, 35, 8)
    cover = lambda parts: [p for lo, hi in zip(parts[2], parts[3], strict=True) for p in range(lo, hi + 1)]
    assert cover(before) == cover(after) == list(range(3000 - 35 + 1))
    assert set(before[0].tolist()) == set(after[0].tolist())


def test_words_are_those_between_ascii_blanks():
    assert len(substring_dedup.word_hashes("a b\tc\nd\x0be\x0cf\rg\xa0h\x1ci j".encode())) == 7
    same = substring_dedup.word_hashes(b"  ab  ba ab")
    assert same[0] == same[2] != same[1]


def test_suffixes_of_crowded_groups_grow_as_the_group(spark, monkeypatch):
    random.seed(34)
    make = lambda n: [f"x{random.randrange(10**9)}" for _ in range(n)]
    base, rows, cut = make(60), [], substring_dedup.suffix_rows

    def counted(*args):
        rows.append(cut(*args).count())
        raise StopIteration  # what follows is not needed here

    monkeypatch.setattr(substring_dedup, "suffix_rows", counted)
    near = [base[: (i := random.randrange(60))] + make(1) + base[i + 1 :] for _ in range(200)]
    some = near + [make(20) + base[:k] + make(20) for k in (9, 40) for _ in range(200)]  # a common line, a common passage
    random.shuffle(some)
    for n in (150, 300, 600):
        docs = [" ".join(t) for t in some[:n]] * 2  # whole copies add nothing
        with pytest.raises(StopIteration):
            substring_dedup.remove_repeats(spark.createDataFrame([(t,) for t in docs], "text string"), crowded=1)
        assert 0 < rows[-1] <= 2 * sum(len(t) - 34 for t in some[:n])  # never more than the table's windows
    assert rows[1] < 2.5 * rows[0] and rows[2] < 2.5 * rows[1]  # by the square each would be four times as many


def test_crowded_segments_give_halves_not_all_their_suffixes(spark, monkeypatch):
    random.seed(35)
    make = lambda n: [f"y{random.randrange(10**9)}" for _ in range(n)]
    base, passage, sizes, cut = make(60), make(40), [], substring_dedup.suffix_rows

    def counted(crowded, *args):
        rows = cut(crowded, *args)
        sizes.append((crowded.count(), rows.count()))
        return rows

    monkeypatch.setattr(substring_dedup, "suffix_rows", counted)
    near = [base[: (i := random.randrange(60))] + make(1) + base[i + 1 :] for _ in range(150)]
    docs = near + [make(20) + line + make(20) for line in (base[:9], passage) for _ in range(150)]
    docs = [" ".join(d) for d in docs + near[:20] + [passage + make(3), passage[2:] + make(1)]]
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), crowded=2000)
    assert {r.doc_id: (r.repeats.n_words, [tuple(s) for s in r.repeats.spans], r.repeats.kept) for r in got.collect()} == dict(enumerate(removed(docs, 35)))
    assert sizes[0][0] > 400 and all(rows <= 2 * crowded for crowded, rows in sizes)


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
