import random
import re
from itertools import permutations

from corpusloom.llm import filter_audit

WORDS = re.compile(r"[^ \t-\r]+")


def plainly(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_at = {}
        for o in ("".join(p) for p in permutations("ABCDE")):
            left = mine
            for step, f in enumerate(o, 1):
                goes = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_at[o, step] = (len(left), len(goes), sum(f in r[1] for r in mine) - len(goes), sum(r[1] == {f} for r in mine), sum(r[2] for r in goes), sum(r[3] for r in goes))
        for (o, step), values in removed_at.items():
            shapley = sum(v[1] for (p, s), v in removed_at.items() if p[s - 1] == o[step - 1])
            out.append((part, o, step, *values, shapley))
    return sorted(out)


def corpus():
    random.seed(22)
    vocabulary = [f"w{i}" for i in range(400)]

    def text():
        size = random.choice([20, 199, 200, 260])
        words = random.choices(vocabulary if random.random() < 0.6 else vocabulary[:30], k=size)
        out = random.choice([" ", "\n", " \t "]).join(words)
        if random.random() < 0.3:
            out = out.upper()
        return out + random.choice(["", "", " &", " ünd"])

    docs = [(i, text(), random.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[random.randrange(40)][1], random.choice(["en", "fr"])) for i in range(60)]
    docs += [(3, docs[3][1], "en"), (None, docs[3][1], "en"), (400, None, "en"), (401, "", "de"), (402, "w " * 50_000, "fr")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 250, 2)] + [(4, 1, 0), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    shaped = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, mask int, quality int")
    return shaped, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_same_as_plain(spark, monkeypatch):
    docs, labels = corpus()
    monkeypatch.setattr(filter_audit, "PARTS", 2)  # tasks hand on what they hold more than once
    got = filter_audit.audit(*frames(spark, docs, labels))
    assert sorted(tuple(r) for r in got.repartition(3).collect()) == plainly(docs, labels)


def test_copies_need_a_smaller_id_and_cross_parts(spark):
    docs = [(5, "a", "en"), (2, "a", "de"), (2, "a", "de"), (None, "a", "fr")]
    rows = filter_audit.masked_rows(*frames(spark, docs, []), "doc_id", "text", "lang").collect()
    assert sorted((r.part, r["mask"] >> 4) for r in rows) == [("de", 0), ("de", 0), ("en", 1), ("fr", 0)]


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    assert set(table[0]) == {5} and set(table[31]) == {0}
    assert table[1 << 2][filter_audit.ORDERS.index("ABDEC")] == 4


def test_empty(spark):
    assert filter_audit.audit(*frames(spark, [], [])).count() == 0
