import json
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello, WORLD's", "İstanbul Σας ΟΔΟΣ", "<|endoftext|>x<|startoftext|> y <|", "a\x85b\xa0c\x1cd", "²x½ ª 漢字 한국어", "é é ﬁ ß ẞ",
    "x" * 3000, "🙂👍🏽", "a_b-c__", "\x00\x01", "ȺȻ ʊ", "the cat " * 2000,
]


def test_encoding_is_the_librarys():
    library, ours = Tokenizer.from_file(PATH), bpe.word_bpe(PATH)
    random.seed(7)
    pool = [chr(c) for c in range(0x250)] + ["Σ", "漢", "가", "́", "K", "'s", " ", "ing", "<|endoftext|>"]
    texts = [t or "" for t in ODD] + ["".join(random.choices(pool, k=random.randint(1, 30))) for _ in range(3000)]
    for text, packed in zip(texts, ours.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert ours.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_few_and_many_words_are_merged_alike(monkeypatch):
    random.seed(17)
    words = ["".join(random.choices("etaoinshré", k=random.randint(1, 40))) for _ in range(400)] + ["th" * 300, "a" * 1000]
    ours = bpe.WordBpe(PATH)
    monkeypatch.setattr(bpe, "FEW", 0)
    many = ours.merge(words)
    monkeypatch.setattr(bpe, "FEW", 1 << 30)
    assert ours.merge(words) == many


def test_a_very_long_word_takes_no_quadratic_time():
    random.seed(18)
    word = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=40_000))
    ours = bpe.word_bpe(PATH)
    began = time.process_time()
    packed = ours.encode([word])[0]
    assert time.process_time() - began < 1
    assert np.frombuffer(packed, "<u4").tolist() == Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids


def test_other_special_tokens(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["added_tokens"] += [spec["added_tokens"][0] | {"id": 49408 + i, "content": c} for i, c in enumerate(("[end]", "[end]s"))]
    path = tmp_path / "more.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library, ours = Tokenizer.from_file(str(path)), bpe.WordBpe(str(path))
    texts = ["a[end]b", "a[end]sb [end", "[end][end]s<|endoftext|>", "none"]
    assert [np.frombuffer(p, "<u4").tolist() for p in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    spec["added_tokens"][0]["lstrip"] = True
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.WordBpe(str(path))


def test_encode_decode_rows(spark):
    library = Tokenizer.from_file(PATH)
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD + ["Hello"] * 2)], "doc_id int, text string, ids int").withColumn("bpe", F.lit(1))
    got = bpe.encode_decode(rows, PATH).select("text", "bpe.n_tokens", "bpe.decoded", bpe.ids_array(F.col("bpe.ids")).alias("ids")).collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_decode(rows.limit(0), PATH).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    random.seed(8)
    for _ in range(150):
        capacity = random.choice([1, 7, 50, 100])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 300))]
        left = {}
        for n, _, bins, each, first, offset in packing.best_fit_plan(Counter(lengths), capacity).tolist():
            for b in range(first, first + bins):
                assert left.get(b, capacity) == capacity - offset
                left[b] = capacity - offset - each * n
        assert sorted(left.values()) == best_fit(lengths, capacity)


def test_pieces_and_places(spark):
    library = Tokenizer.from_file(PATH)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, piece int")
    got = packing.pack_documents(frame, PATH, capacity=64).toPandas()
    wanted = Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, begin in enumerate(range(0, len(ids), 64)):
            part = ids[begin : begin + 64]
            wanted[(i, p, begin, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = zip(*(got[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), strict=True)
    assert Counter((None if i != i else int(i), *map(int, r)) for i, *r in rows) == wanted
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 64
    assert got["sequence_id"].nunique() == len(best_fit(got["length"].tolist(), 64))
    assert packing.pack_documents(frame.limit(0), PATH).count() == 0
