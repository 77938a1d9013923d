"""Operators over rows that share ids, hold nulls or clash in their columns' names."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators import arrays, attention, filters, metrics, sampling, tokens
from corpusloom.queries import QUERIES
from corpusloom.sources import text as sources

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def test_first_of_equals(spark):
    key = [F.col("text"), F.col("more")]
    rows = [(0, "B", None, "x"), (1, "A", None, "x"), (1, "B", None, "x"), (2, None, "a", "x"), (3, "a", None, "x"), (4, None, None, "x"), (4, None, None, "x"), (None, "A", None, "x")]
    frame = spark.createDataFrame(rows, "at int, text string, more string, row string")
    got = filters.first_of_equals(frame, key, ["at"]).collect()
    want = [(0, "B", None), (2, None, "a"), (3, "a", None), (4, None, None), (None, "A", None)]
    assert sorted(((r["at"], r["text"], r["more"]) for r in got), key=repr) == sorted(want, key=repr)
    assert got[0]["row"] == "x" and filters.first_of_equals(frame.limit(0), key, ["at"]).count() == 0


def plain_repetition(text, n):
    bare = "".join((text or "").split())
    counts = Counter(bare[i : i + n] for i in range(len(bare) - n + 1))
    return sum(c for c in counts.values() if c > 1) / sum(counts.values()) if len(bare) >= 2 * n else 0.0


def test_ngrams_of_rows_that_share_an_id(spark):
    random.seed(4)
    texts = ["abababab", "cdefghij", None, "", "a b", "𝒂𝒂𝒂𝒂b", *("".join(random.choices("ab c", k=random.randint(0, 30))) for _ in range(60))]
    frame = spark.createDataFrame([(1, t) for t in texts], "doc_id int, text string")
    for n in (1, 2, 3, 4):
        got = sorted(round(r.repetition, 9) for r in metrics.ngram_repetition(frame, n).collect())
        assert got == sorted(round(plain_repetition(t, n), 9) for t in texts)
        kinds = lambda b: len({b[i : i + n] for i in range(len(b) - n + 1)}) / (len(b) - n + 1) if len(b) >= n else 0.0  # noqa: E731, B023
        got = sorted(round(r.distinct, 9) for r in metrics.distinct_n(frame, n).collect())
        assert got == sorted(round(kinds("".join((t or "").split())), 9) for t in texts)


def test_bad_rows_are_left_out_and_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "a", "n": 1}\nbad\n{"q": null}\n{"q": "b", "n": "x"}\n[1]\n\n{"q": "c"}\n')
    parsed = sources.parsed_rows(spark, str(tmp_path), "q string, n int")
    assert sorted((r.q or "", r.n or 0) for r in sources.read_rows(spark, str(tmp_path), "q string, n int").collect()) == [("", 0), ("a", 1), ("c", 0)]
    assert tuple(sources.bad_count(parsed).first()) == (6, 3)
    assert tuple(sources.bad_count(sources.parsed_rows(spark, str(tmp_path), "q string, n int", most=2)).first()) == (2, 1)


def test_evaluation_record_is_sorted(spark):
    frame = spark.createDataFrame([("m", "abcabcabc 用户：x"), ("m", None), ("k", "abcdefgh")], "model string, text string")
    got = metrics.evaluation_record(frame, ["model"], F.length(F.coalesce("text", F.lit("")))).collect()
    assert [r.model for r in got] == ["k", "m"] and got[0].rep3 == 0 and got[1].turn_structure == 0.5
    assert got[1].rep3 == round(plain_repetition("abcabcabc用户：x", 3) / 2, 4) and got[1].avg_len_tokens == 7.0


def test_acceptance(spark):
    frame = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", True)], "k string, keep boolean")
    assert sorted(map(tuple, filters.acceptance(frame, ["k"]).collect())) == [("a", 3, 1, pytest.approx(1 / 3)), ("b", 1, 1, 1.0)]
    assert filters.acceptance(frame.limit(0), []).first()["rate"] == 0


def test_filter_sample_of_short_and_large_ids(spark):
    rows = [([1] * 39, "好" * 9), (list(range(2**30, 2**30 + 40)), "好" * 9), ([1, 2] * 30, "好" * 9), (None, "好"), ([], "")]
    frame = spark.createDataFrame(rows, "ids array<int>, text string")
    assert [r[0] for r in frame.select(filters.filter_sample(F.col("ids"), F.col("text"))).collect()] == [False, True, False, False, False]


def test_characters_encode_and_decode(spark):
    docs = spark.createDataFrame([(1, "b𝒂é b"), (1, ""), (2, None)], "doc_id int, text string")
    vocab = tokens.char_vocab(docs)
    coded = tokens.char_encode(docs, vocab)
    assert sorted(list(r.ids) for r in coded.collect()) == [[], [], [1, 3, 2, 0, 1]]
    assert sorted(r.text for r in tokens.char_decode(coded, vocab).collect()) == ["", "", "b𝒂é b"]
    assert [list(r.ids) for r in tokens.char_encode(docs, vocab.where("ch <> 'b'")).where("size(ids) > 0").collect()] == [[3, 2, 0]]


def test_ranked_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(i, "s", i * 7, "k") for i in range(20)], "id int, source string, _key int, _bucket string")
    got = sampling.ranked(frame, ["source"], 1, ["id"]).collect()
    assert all(r["_key"] == r["id"] * 7 and r["_bucket"] == "k" for r in got) and sorted(r.rn for r in got) == list(range(1, 21))


def test_random_windows(spark):
    frame = spark.createDataFrame([(1, list(range(50))), (2, [1, 2])], "k int, ids array<int>")
    got = tokens.random_windows(frame, ["k"], "ids", 8, 5).collect()
    assert len(got) == 5 and all(list(r.y) == [i + 1 for i in r.x] and len(r.x) == 8 and r.k == 1 for r in got)


def test_masked_targets(spark):
    frame = spark.createDataFrame([([1, 2, 3], [True, False, None])], "y array<int>, m array<boolean>")
    assert list(frame.select(tokens.masked_targets(F.col("y"), F.col("m"))).first()[0]) == [1, -100, -100]


def test_masks_and_totals_by_pieces_of_a_batch():
    texts = pa.array(["x the a. b an c", None, "", "t", "hthe. th", "h an"] * 300)
    marks, sizes = ((116, 104), ((97, 110),), (46, 32)), []
    ids = arrays.code_points_of(texts)

    def plain(some):
        out, inside = [], False
        for i, c in enumerate(some or ""):
            pairs = [some[i : i + 2], some[i - 1 : i + 1] if i else ""]
            hit = next((p for p in pairs if p in ("th", "an", ". ")), None)
            out.append(inside if hit is None else hit != ". ")
            inside = some[i : i + 2] == "th" if some[i : i + 2] in ("th", "an", ". ") else inside
        return None if some is None else out

    want = [plain(t) for t in texts.to_pylist()]
    assert tokens.loss_mask_of(ids, *marks).to_pylist() == want
    targets = arrays.where_true_of(ids, tokens.loss_mask_of(ids, *marks), tokens.IGNORED)
    for (piece,) in arrays.pieces((texts,), 64):
        sizes.append(pc.sum(pc.binary_length(piece)).as_py())
        assert pc.sum(pc.binary_length(piece.slice(0, len(piece) - 1))).as_py() <= 64
    assert len(sizes) > 50 and sum(sizes) == pc.sum(pc.binary_length(texts)).as_py()
    pieces = [arrays.totals_of(t, tokens.IGNORED) for (t,) in arrays.pieces((targets,), 64)]
    got = pa.concat_arrays(pieces).to_pylist()
    assert [g["n"] for g in got] == [sum(w or []) for w in want]
    assert [g["total"] or 0 for g in got] == [sum(ord(c) for c, m in zip(t or "", w or []) if m) for t, w in zip(texts.to_pylist(), want)]
    assert arrays.totals_of(arrays.code_points_of(texts.slice(0, 0))).to_pylist() == []


def most_mb(work, texts):
    """MB of Python and numpy, and of Arrow, that a function of a batch holds at most besides it."""
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        arrays.piecewise(work)(texts)
        return tracemalloc.get_traced_memory()[1] / 1e6, pool.max_memory() / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_masked_targets_send_no_arrays_and_grow_by_pieces(spark):
    texts = pa.array(["then a man. " * 250] * 4000)  # 12 MB, a third of a batch of documents
    numpy_mb, arrow_mb = most_mb(lambda t: tokens.masked_totals_of(t, (116, 104), ((97, 110),), (46, 32)), texts)
    assert numpy_mb < 50 and arrow_mb < 20  # 720 and 150 for the batch at once
    plan = plan_of(QUERIES["masked_targets"](spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("AS ids#") == 0


def test_ahead_totals_send_no_arrays_and_grow_by_pieces(spark):
    rows = ["abcd", "ab", "é", "", None, "x" * 70]
    want = [[(sum(1 for _ in (t or "")[k:]), sum(i * ord(c) for i, c in enumerate((t or "")[k:]))) for k in (1, 2, 3)] for t in rows]
    frame = spark.createDataFrame([(t,) for t in rows], "t string").coalesce(1).select(attention.ahead_totals(F.col("t"), 3).alias("a"))
    assert [[(r.a[k].n, r.a[k].places or 0) for k in range(3)] for r in frame.collect()] == want
    numpy_mb, arrow_mb = most_mb(lambda t: attention.ahead_totals_of(t, 3), pa.array(["then a man. " * 250] * 4000))
    assert numpy_mb < 50 and arrow_mb < 20
    plan = plan_of(QUERIES["mtp_targets"](spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("AS ids#") == 0


def test_encoding_grows_by_pieces(spark):
    rows = [(1, "b𝒂é b"), (1, "bé"), (2, "zz"), (3, None), (3, ""), (4, "é")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    vocab = spark.createDataFrame([("b", 5), ("é", 2**40), ("𝒂", 7)], "ch string, id long")
    assert sorted(map(tuple, tokens.char_totals(docs, vocab).collect()), key=repr) == [(1, 6, 2 * 2**40 + 22), (2, 0, None), (3, 0, None), (4, 1, 2**40)]
    none = tokens.char_totals(docs, vocab.limit(0))
    assert sorted(map(tuple, none.collect())) == [(i, 0, None) for i in (1, 2, 3, 4)]
    assert [list(r.ids) for r in tokens.char_encode(docs, vocab.limit(0)).collect()] == [[]] * 6
    encode = tokens.char_encoder(docs, spark.createDataFrame([(c, n) for n, c in enumerate(" .aehmnt")], "ch string, id long"))
    numpy_mb, arrow_mb = most_mb(lambda t: arrays.totals_of(encode(t)), pa.array(["then a man. " * 250] * 4000))
    assert numpy_mb < 50 and arrow_mb < 20
    plan = plan_of(QUERIES["char_encode_len"](spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("AS ids#") == 0 and "aggregate(" not in plan


def test_texts_to_token_file_and_back(spark, tmp_path):
    texts = ["hello world", "", "é你好 " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    coded = docs.select("id", tokens.bpe_encode(F.coalesce("text", F.lit("")), BYTE_BPE, append=50256).alias("ids"))
    n = sources.write_tokens(coded, str(tmp_path / "train"), ["id"])
    parts = sources.read_tokens(spark, str(tmp_path / "train")).orderBy("source", "part").collect()
    ids = [i for r in parts for i in r.ids]
    assert len(ids) == n and ids.count(50256) == 3
    read = spark.createDataFrame([(ids,)], "ids array<int>")
    assert read.select(tokens.bpe_decode(F.col("ids"), BYTE_BPE)).first()[0].split("<|endoftext|>")[:3] == texts


def test_chunks_are_asked_for(spark):
    docs = spark.createDataFrame([("hello world",), ("",)], "text string")
    sizes = lambda **how: [len(r[0]) for r in docs.select(tokens.bpe_encode(F.col("text"), BYTE_BPE, **how)).collect()]
    assert (sizes(), sizes(chunk=1), sizes(chunk=6, append=0)) == ([2, 0], [11, 0], [4, 1])


def test_cut_at_turn(spark):
    docs = spark.createDataFrame([("you said\nUser: hello",), ("no marker",)], "text string")
    coded = docs.select("text", tokens.bpe_encode(F.col("text"), BYTE_BPE).alias("ids"))
    cut = coded.select("text", tokens.bpe_decode(tokens.cut_at_turn(F.col("ids"), BYTE_BPE), BYTE_BPE).alias("cut"))
    assert {r.text: r.cut for r in cut.collect()} == {"you said\nUser: hello": "you said", "no marker": "no marker"}


def test_newton_schulz_is_nearly_orthogonal(spark):
    m = np.eye(6) + 0.1 * np.random.default_rng(1).standard_normal((6, 6))
    frame = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>")
    y = np.array(frame.select(vx.newton_schulz(F.col("m"))).first()[0])
    assert np.all(np.abs(np.linalg.svd(y)[1] - 1) < 0.5)


def test_limit_after_append(spark):
    roots = [spark.createDataFrame([(g, i) for i in range(n)], "g string, i int") for g, n in (("a", 3), ("b", 9), ("c", 4), ("d", 0))]
    taken = lambda most: sorted((r.g, r.i) for r in filters.appended(roots, ["i"], most).collect())
    assert taken(5) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    assert taken(2) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    assert len(taken(0)) == 16 and taken(100) == taken(0)


def test_penalty_of_a_history(spark):
    logits = spark.createDataFrame([(1, 5, 2.0), (1, 6, -1.0), (1, 7, None), (2, 5, 1.0), (None, 5, 1.0)], "k int, tok int, logit double")
    history = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 6), (1, 3, None), (3, 0, 5)], "k int, pos int, tok int")
    got = lambda **how: sorted(attention.penalise(logits, history, ["k"], 2.0, **how).collect(), key=repr)
    assert [(r.k, r.tok, r.logit) for r in got()] == [(1, 5, 0.5), (1, 6, -2.0), (1, 7, None), (2, 5, 1.0), (None, 5, 1.0)]
    assert [r.logit for r in got(once=True)] == [1.0, -2.0, None, 1.0, 1.0]
    assert [r.logit for r in got(context=3)] == [1.0, -2.0, None, 1.0, 1.0]
    assert [r.logit for r in got(context=1)] == [2.0, -1.0, None, 1.0, 1.0]


def test_token_counts_of_whole_texts(spark):
    from tokenizers import Tokenizer

    from corpusloom.queries import queries

    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs)
    assert sorted(tuple(r) for r in queries()["bpe_token_count"](spark, folder).collect()) == want


def test_character_numbers_and_back(spark):
    docs = spark.createDataFrame([(1, "abca"), (1, "你好"), (2, ""), (3, None)], "doc_id int, text string")
    vocab = tokens.char_vocab(docs)
    back = tokens.char_decode(tokens.char_encode(docs, vocab), vocab).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, "abca"), (1, "你好"), (2, ""), (3, "")]


def test_cut_at_a_turn(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    ids = tokenizer.encode("好 yes\n用户：more", add_special_tokens=False).ids
    frame = spark.createDataFrame([(ids,), ([],)], "ids array<int>")
    whole, none = (r[0] for r in frame.select(tokens.cut_at_turn(F.col("ids"), BYTE_BPE, ("\n用户：",))).collect())
    assert tokenizer.decode(whole) == "好 yes" and none == []
