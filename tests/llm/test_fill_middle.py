import hashlib
import random
import re

from corpusloom.llm import fill_middle

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plainly(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < spm_rate
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def corpus():
    random.seed(21)
    texts = ["".join(random.choices(["ab", " ", "\n", "\x0b", "é", "𝄞", "\x01", "\x02", "c", "e", "\x01c", "\x02e", "<", "P>", "\xa0"], k=random.randint(0, 40))) for _ in range(200)]
    return [*enumerate(texts), (7, texts[7]), (None, "a null id"), (300, None), (301, ""), (302, "  \t\n "), (303, "a <P> b"), (304, "a<M>"), (305, "word " * 200_000), (306, "x" * 500_000), (307, "$0 \\1 $"), (-5, "a b c")]


def test_same_as_plain(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fim string, n string")
    for rate, spm_rate in ((50, 80), (100, 0), (100, 100)):
        done = fill_middle.transform(frame, rate=rate, spm_rate=spm_rate)
        assert done.columns == ["doc_id", "text", "n", "fim"]
        got = done.select("doc_id", "text", "fim.*", fill_middle.restored(done.fim.output, done.fim.form).alias("again")).collect()
        assert all(r.again == (r.text or "") for r in got)
        found = sorted((tuple(r)[:-1] for r in got), key=repr)
        assert found == sorted(((i, t, *plainly(i, t, rate, spm_rate)) for i, t in rows), key=repr)
    assert {plainly(i, t)[1] for i, t in rows} == {"plain", "spm", "psm"}


def test_no_shuffle_and_no_python(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fill_middle.transform(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
