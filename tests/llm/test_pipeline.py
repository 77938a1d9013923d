import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import near_dup, pii, quality
from corpusloom.llm.tables import materialise, read_table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name in list(stages)[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stages[name](spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept[name] = before, {r.doc_id: r.text for r in docs.collect()}
    before, after = kept["quality"]
    scores = quality.classify(read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels"))
    assert set(after) == {r.doc_id for r in scores.collect() if r.score >= 0.7}
    before, after = kept["exact"]
    assert set(after) == set({t: i for i, t in sorted(before.items())}.values())
    before, after = kept["near"]
    sets = {i: set(near_dup.shingles(t).tolist()) for i, t in before.items()}
    for i in set(before) - set(after):
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i)
    ids = sorted(after)
    assert not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for n, i in enumerate(ids) for j in ids[:n] if sets[i])
    before, after = kept["pii"]
    assert set(before) == set(after)
    assert all(not pii.base_spans(after[i]) and (pii.base_spans(before[i]) or "<" in after[i] or after[i] == before[i]) for i in before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, docs, FOLDER).toPandas()
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == lengths


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and an empty table."""
    good = read_table(spark, FOLDER, "documents").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(*r, 0.5, "x", "y") for r in good]
    rows += [(1000, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (1001, "", "en", "s", 0, 0.1, "", "z")]
    rows += [(None, good[0].text, "en", "s", 1, 0.2, "a", "b")] * 2 + [(1002, good[1].text, "en", "s", 1, 0.3, "a", "b")] * 2
    rows += [(1003, "call 1.2.3.4 " + "the long word " * 60000, "en", "s", 1, 0.4, "a", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, _id string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0
        got = stage(spark, docs, FOLDER).collect()
        if name == "packing":
            assert sum(r.start == 0 for r in got) == len(rows)
            continue
        assert empty.columns == docs.columns
        key = lambda r: (repr(r["doc_id"]), r["lang"], r["source"], r["score"], r["row"], r["_id"])
        given = {key(r) for r in docs.collect()}
        assert {key(r) for r in got} <= given
        if name == "exact":
            assert len(got) == len({r[1] or "" for r in rows})
        elif name == "near":
            assert sum(r.doc_id is None for r in got) == 3 and {1000, 1001} <= {r.doc_id for r in got}
        elif name == "pii":
            assert len(got) == len(rows) and sum(r.text is None and r.n_chars is None for r in got) == 2
            assert all("1.2.3.4" not in r.text for r in got if r.doc_id == 1003)
