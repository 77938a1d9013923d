import random

from pyspark.sql import functions as F

from corpusloom.operators import dialogue, filters, sampling, tokens


def test_shapes(spark):
    rows = spark.createDataFrame(
        [(" q ", "a"), ("", "a"), (None, "a")], "question string, answer_zh string"
    )
    assert [r.block for r in dialogue.to_blocks(rows, "question").collect()] == ["用户：q\n模型：a"]
    talk = spark.createDataFrame(
        [([("human", "a"), ("system", "s"), ("gpt", " b "), ("human", " ")],), ([],), (None,)],
        "conversations array<struct<from: string, value: string>>",
    )
    assert [r.block for r in dialogue.to_blocks(talk, "conversations").collect()] == ["用户：a\n模型：b"]
    both = spark.createDataFrame([([("a", "b"), (None, "c")],)], "conversation array<struct<human: string, assistant: string>>")
    assert [r.block for r in dialogue.to_blocks(both, "exchanges").collect()] == ["用户：a\n模型：b\n模型：c"]
    told = spark.createDataFrame([("do", "this", "done"), ("do", "", "done"), ("do", "", None)], "instruction string, input string, output string")
    assert [r.block for r in dialogue.to_blocks(told, "instruction").collect()] == ["用户：do\nthis\n模型：done", "用户：do\n模型：done"]
    history = spark.createDataFrame(
        [([("user", "a"), ("assistant", "b"), ("user", "c"), ("tool", "x")], "d", "no"), (None, "d", "no")],
        "prompt array<struct<role: string, content: string>>, chosen string, rejected string",
    )
    assert [r.block for r in dialogue.to_blocks(history, "messages").collect()] == ["用户：a\n模型：b\n用户：c\n模型：d"]
    answers = spark.createDataFrame([("q", "答"), ("q", "作为一个"), ("q" * 301, "a"), ("q", "a" * 601)], "INSTRUCTION string, RESPONSE string")
    assert [r.block for r in dialogue.to_blocks(answers, "answers").collect()] == ["用户：q\n模型：答"]


def marked(block):
    out, open_ = [], False
    for line in block.split("\n"):
        s = line.strip()
        if s.startswith(("用户：", "模型：")) or not s:
            if open_:
                out.append("<eos>")
            open_ = s.startswith("模型：")
        if line:
            out.append(line)
    return "\n".join(out + ["<eos>"] * open_)


def test_insert_eos_is_the_line_machine(spark):
    random.seed(1)
    lines = ["用户：a", "模型：b", "  模型：c", "more", "", "  ", "用户：d"]
    blocks = ["\n".join(random.choices(lines, k=random.randint(1, 8))) for _ in range(200)]
    keyed = [(i // 3, b) for i, b in enumerate([*blocks, ""])]  # keys repeat
    got = dialogue.insert_eos(spark.createDataFrame([*keyed, (None, None)], "id int, block string"), ["id"]).collect()
    assert [(r.id, r.block) for r in got] == [(i, marked(b)) for i, b in keyed] + [(None, None)]


def test_log_pairs(spark):
    def event(kind, content):
        import json

        return json.dumps({"type": kind, "message": {"content": content}})

    text = lambda t: {"type": "text", "text": t}
    lines = [
        event("user", "q1"), event("assistant", [{"type": "thinking", "thinking": "…"}]), event("assistant", [text("a1"), text("b1")]),
        event("assistant", [text("late")]), event("user", [text("q2")]), event("assistant", [{"type": "tool_use"}, text("x")]),
        event("assistant", [text("no")]), "not json", event("user", [{"type": "image"}]), event("assistant", [text("no")]),
        event("user", "q3"), event("summary", "s"), event("assistant", [text("a3")]),
    ]
    frame = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "path string, line_no long, value string")
    pairs = dialogue.first_replies(dialogue.log_events(frame), ["path"], ["line_no"]).orderBy("line_no").collect()
    assert [(p.user, p.asst) for p in pairs] == [("q1", "a1 b1"), ("q3", "a3")]


def test_session_pairs(spark):
    rows = [
        ("s", 0, "user", None, None, "u1"), ("s", 1, "chunk", 1, 0, "he"), ("s", 2, "chunk", 1, 1, "wor"), ("s", 3, "chunk", 1, 0, "llo "),
        ("s", 4, "chunk", 1, 1, "ld"), ("s", 5, "end", None, None, None), ("s", 6, "user", None, None, "u2"), ("s", 7, "chunk", 2, 0, "bye"),
        ("s", 8, "user", None, None, "u3"), ("t", 0, "user", None, None, "v1"), ("t", 1, "chunk", 1, 0, "w"),
    ]
    frame = spark.createDataFrame(rows, "session string, seq long, kind string, turn int, idx int, text string")
    got = sorted((r.session, r.nth, r.user, r.asst) for r in dialogue.session_pairs(frame).collect())
    assert got == [("s", 1, "u1", "hello world"), ("s", 2, "u2", "bye"), ("t", 1, "v1", "w")]


def test_cascade_reasons(spark):
    long_user = "你好世界" * 60
    pairs = [
        ("好的", "好的好的好的好的", "too_short"), ("然后呢", "这是一个很好的回答", "stopword_user"), (long_user, "这是一个很好的回答", "too_long"),
        ("hello there", "this is english", "low_ratio"), ("哈哈哈哈", "这是一个很好的回答", "degenerate"), ("今天天气怎样", "今天天气怎样很好", "echo"),
        ("天气怎样", "天气怎样很好呀好", None), ("天气怎样", "天气怎样很好呀好", "dup"), ("ok", "？？？？？？？", "too_short"),
    ]
    rows = [(i, u, a) for i, (u, a, _) in enumerate(pairs)] + [(99, "", "x"), (100, None, "x")]
    got = filters.filter_pairs(spark.createDataFrame(rows, "ord int, user string, asst string"), ["ord"])
    assert [r.drop_reason for r in got.orderBy("ord").collect()] == [p[2] for p in pairs]


def test_copies_of_a_pair_are_spread(spark):
    rows = [(i // 2, i % 2, "天气怎样" if i % 3 else f"天气怎样{i}", "天气怎样很好呀好") for i in range(3000)]
    rows += [(1, 0, "天气怎样", "天气怎样很好呀好"), (None, 0, "明天天气怎样", "天气很好呀好"), (None, 0, "明天天气怎样", "天气很好呀好")]
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "a int, b int, user string, asst string")
        got = filters.filter_pairs(frame, ["a", "b"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert len(got) == len(rows)
    hot = [r for r in got if r.user == "天气怎样"]
    assert [(r.a, r.b) for r in hot if r.drop_reason is None] == [(0, 1)]
    assert len({r.task for r in hot}) > 1
    assert sorted(r.drop_reason or "" for r in got if r.a is None) == ["", "dup"]


def test_split_counts_are_exact(spark):
    rows = spark.range(1007).withColumn("source", F.when(F.col("id") < 900, "big").otherwise("small"))
    parts = sampling.split(rows, ["source"], ["id"]).groupBy("source", "split").count().collect()
    assert {(r.source, r.split): r["count"] for r in parts} == {
        ("big", "train"): 810, ("big", "val"): 90, ("small", "train"): 96, ("small", "val"): 11,
    }
    few = sampling.down_sample(rows, F.lit(0.0001), ["source"], ["id"])
    assert few.count() == 2
    assert sampling.down_sample(rows, F.lit(0.0), ["source"], ["id"]).count() == 0


def test_length_batches(spark):
    rows = spark.createDataFrame([(i, list(range(i % 7 + 1))) for i in range(40)], "id int, ids array<int>")
    got = sampling.length_batches(rows, "ids", ["id"], 4, keep_last=5).toPandas()
    assert len(got) == 40 and got["ids"].map(len).max() == 5
    assert (got.groupby("batch")["ids"].agg(lambda x: x.map(len).nunique()) == 1).all()


def masked(ids, opens, closes, blank):
    out, i, open_ = [], 0, False
    while i < len(ids):
        pair = tuple(ids[i : i + 2])
        if pair == opens or pair in closes:
            open_ = pair == opens
            out += [True, True]
            i += 2
        elif pair == blank:
            open_ = False
            out += [False, False]
            i += 2
        else:
            out.append(open_)
            i += 1
    return out


def test_loss_mask_is_the_token_machine(spark):
    random.seed(2)
    streams = [[random.choice([1, 2, 3, 4, 5]) for _ in range(30)] for _ in range(200)]
    frame = spark.createDataFrame([(1, ids) for ids in [*streams, [], [4], [1, 2]]] + [(1, None)], "s int, ids array<int>")
    got = frame.select("ids", tokens.loss_mask(F.col("ids"), (1, 2), ((3, 2),), (4, 4)).alias("mask")).collect()
    assert len(got) == 204
    assert all((r.mask is None and r.ids is None) or r.mask == masked(r.ids, (1, 2), ((3, 2),), (4, 4)) for r in got)
