import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


#: Inputs and what is left of them, written by hand.
NOISY = {
    "a```x\ny```b": "a b",
    "`" + "c" * 80 + "`": "",
    "`" + "c" * 81 + "`": "`" + "c" * 81 + "`",
    "see https://a.b/c\u3000then": "see then",
    r"C:\\x C:\x": r"C:\x",
    "/home/u/a b": "b",
    "x\x01y\x0bz": "x y z",
    "": "",
    "  ": "",
    "\u3000你好\u3000": "你好",
    "c:\\\\é.txt": "",
}


def test_strip_noise(spark):
    assert values(spark, list(NOISY), tx.strip_noise) == list(NOISY.values())


def test_class_ratio(spark):
    assert values(spark, ["", "你好，世", "'", '"', "  ", "a你 b"], tx.class_ratio) == [0, 1, 1, 0, 0, pytest.approx(1 / 3)]


def test_degenerate(spark):
    assert values(spark, ["", "，。 !", "aa", "aaa", "a a a", "aaaab", "𝒂𝒂𝒂"], tx.is_degenerate) == [True, True, False, True, True, False, True]


def test_clip_and_truncate(spark):
    assert values(spark, ["好。坏", "无", "a!b?c", "x。\ny"], tx.clip_sentence) == ["好。", "无", "a!b?", "x。"]
    texts = ["a\n模型：b\n用户：c", "a\nUser:b", "\n用户：", "plain"]
    assert values(spark, texts, tx.truncate_at_turn) == ["a\n模型：b", "a", "", "plain"]


def test_turn_structure(spark):
    got = values(spark, ["用户：a\n模型:b", "用户：a", "用户:a 用户:b Model"], tx.turn_structure)
    assert [tuple(g) for g in got] == [(1, 1, 1, True), (1, 0, 1, False), (2, 0, 2, True)]


def test_small_functions(spark):
    assert [r.s for r in spark.createDataFrame([(1280,), (5376,), (1792,)], "n long").select(tx.human_size(F.col("n")).alias("s")).collect()] == ["1.2 KB", "5.2 KB", "1.8 KB"]
    rows = spark.createDataFrame([([5, 6, 0, 7], 1536), ([5], 10), ([0], 3 * 1024**3)], "ids array<int>, n long")
    got = rows.select(tx.eos_cut(F.col("ids"), 0).alias("e"), tx.human_size(F.col("n")).alias("s")).collect()
    assert [(r.e.eos_pos, list(r.e.ids), r.s) for r in got] == [(2, [5, 6], "1.5 KB"), (None, [5], "10.0 B"), (0, [], "3.0 GB")]


def test_prompts_prefixes_and_spaces(spark):
    assert values(spark, ["你好", ""], tx.prompt) == ["用户：你好\n模型：", "用户：\n模型："]
    assert values(spark, ["ab c", "b"], lambda t: tx.without_prefix(t, F.lit("ab"))) == [" c", "b"]
    assert values(spark, ["a\u3000b\u3000"], tx.unify_spaces) == ["a b "]
