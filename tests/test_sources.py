import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tokens
from corpusloom.plans import build, config, manifest
from corpusloom.sources import text as src
from corpusloom.sources import zstd_lines


def test_blocks_and_logs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nline\n\n\n\n  two \n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "l.jsonl").write_text('{"a": 1}\n\nbad\n', encoding="utf-8")
    assert [r.block for r in src.read_blocks(spark, str(tmp_path)).collect()] == ["one\nline", "two"]
    assert [(r.line_no, r.value) for r in src.read_log_lines(spark, str(tmp_path)).collect()] == [(0, '{"a": 1}'), (2, "bad")]
    rows = src.read_rows(spark, str(tmp_path / "sub" / "l.jsonl"), "a int").collect()
    assert 1 in [r.a for r in rows]


def test_zstd(spark, tmp_path):
    import zstandard

    (tmp_path / "x.zst").write_bytes(zstandard.compress("{}\n\nä\n".encode()))
    assert [(r.line_no, r.value) for r in zstd_lines.read_zstd_lines(spark, str(tmp_path)).collect()] == [(0, "{}"), (2, "ä")]


def test_tokens_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i, 65535, 7]) for i in range(50)], "id int, ids array<int>")
    assert src.write_tokens(rows, str(tmp_path / "bin"), ["id"]) == 150
    parts = src.read_tokens(spark, str(tmp_path / "bin")).orderBy("source", "part").collect()
    assert [t for p in parts for t in p.ids] == [t for i in range(50) for t in (i, 65535, 7)]


def test_lines_of_split_logs_stay_in_order(spark, tmp_path):
    lines = [f"{i:05d}" + "x" * (i % 7) for i in range(3000)]
    (tmp_path / "a b.jsonl").write_text("\r\n".join(lines), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n" * 500 + "last", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        frame = src.read_log_lines(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 20
        got = sorted((r.path, r.line_no, r.value) for r in frame.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [v for _, _, v in got] == [*lines, "last"] and len({g[:2] for g in got}) == 3001


def test_token_files_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "READ_BYTES", 64)
    ids = np.arange(1000, dtype="<u2")
    (tmp_path / "a b.bin").write_bytes(ids.tobytes() + b"x")  # an odd last byte
    (tmp_path / "none.bin").write_bytes(b"")
    (tmp_path / "one.bin").write_bytes(b"\x07")
    parts = src.read_tokens(spark, str(tmp_path)).orderBy("source", "part").collect()
    assert {r.source for r in parts} == {"a b.bin"} and [i for r in parts for i in r.ids] == list(range(1000))


def test_folder_size_and_stamp(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "manifest.json").write_text("{}")
    (tmp_path / "x").write_bytes(b"abc")
    assert tuple(src.folder_size(spark, str(tmp_path)).first()) == (2, 5)
    runs = spark.createDataFrame([("a",), (None,)], "run string")
    stamp = {r.data_manifest_sha256 for r in manifest.stamp_data(runs, str(tmp_path / "d" / "manifest.json")).collect()}
    assert stamp == {hashlib.sha256(b"{}").hexdigest()}
    assert {r.data_manifest_sha256 for r in manifest.stamp_data(runs, str(tmp_path / "none.json")).collect()} == {None}


def test_results_and_index(spark, tmp_path):
    for run, vals in (("a", "0,3,2.5,1,1,1\n1,2,2.0,1,1,2\n\n2,2,2.0,1,1,3\n"), ("b", "0,3,1.5,1,1,1\n1,2,oops,1,1,2\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text("step,train/loss,val/loss,lr,mfu,time\n" + vals)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "best.pt").write_bytes(b"x")
    got = manifest.experiment_index(spark, str(tmp_path)).collect()
    assert [(r.run, r.best_val, r.best_step, r.n_rows) for r in got] == [("b", 1.5, 0, 2), ("a", 2.0, 1, 3), ("c", None, None, None)]
    assert [r.run for r in manifest.experiment_index(spark, str(tmp_path), only="./a").collect()] == ["a"]
    listed = manifest.release_manifest(spark, str(tmp_path / "c")).collect()
    assert listed[0].file == "best.pt" and listed[0].size == "1.0 B" and len(listed[0].sha256) == 64


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text(json.dumps({"x": 1, "y": "p"}))
    (tmp_path / "b.yaml").write_text(json.dumps({"extends": "a.yaml", "x": 2, "z": 3}))
    (tmp_path / "c.yaml").write_text(json.dumps({"base": "b.yaml", "y": "q"}))
    assert config.load(tmp_path / "c.yaml") == {"x": 2, "y": "q", "z": 3}
    values, unknown = config.resolve({"x": 0, "y": "", "f": False}, tmp_path / "c.yaml", ["--x=5", "--f=true"])
    assert values == {"x": 5, "y": "q", "f": True, "z": 3} and unknown == ["z"]
    (tmp_path / "d.yaml").write_text(json.dumps({"extends": "d.yaml"}))
    with pytest.raises(ValueError):
        config.load(tmp_path / "d.yaml")
    with pytest.raises(TypeError):
        config.resolve({"x": 0}, None, ["--x=word"])
    with pytest.raises(ValueError):
        config.resolve({"x": 0}, None, ["--unknown=1"])


def test_corpus_build(spark):
    rows = spark.createDataFrame([(i, f"q{i % 15}", f"a{i % 15}") for i in range(20)], "id int, question string, answer_zh string")
    blocks = build.build_blocks({"s": (rows, "question"), "t": (rows, "no such shape")})
    corpus = build.build_corpus(blocks).collect()
    assert len(corpus) == 15 and sum(r.split == "train" for r in corpus) == 13
    assert all(r.block.endswith("<eos>") for r in corpus)


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    letters = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    merges = [("h", "e"), ("l", "l")]
    vocab = letters | {a + b: len(letters) + i for i, (a, b) in enumerate(merges)}
    t = Tokenizer(models.BPE(vocab, merges))
    t.pre_tokenizer, t.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    spec = t.to_str()
    rows = spark.createDataFrame([("你好 hello 🙂",), ("",), (None,)], "t string")
    got = rows.select("t", tokens.bpe_encode(F.col("t"), spec).alias("ids"))
    got = got.select("t", "ids", tokens.bpe_decode(F.col("ids"), spec).alias("d"), tokens.streaming_decode(F.col("ids"), spec).alias("p")).collect()
    assert [(r.d, "".join(r.p)) for r in got] == [("你好 hello 🙂", "你好 hello 🙂"), ("", ""), ("", "")]
    assert np.array(got[0].p).size < len(got[0].ids)
