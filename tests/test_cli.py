import json

from corpusloom.cli import main
from corpusloom.sources import text as src


def test_commands(spark, tmp_path, capsys):
    main(["list"])
    assert "drop_reasons" in capsys.readouterr().out.split()
    main(["run", "drop_reasons", "/root/testdata/sf0.001", "--out", f"{tmp_path}/reasons"])
    assert {r.reason for r in spark.read.parquet(f"{tmp_path}/reasons").collect()} >= {"kept"}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("\n\n".join(f"用户：q{i}\n模型：a{i}" for i in range(20)), encoding="utf-8")
    main(["corpus", f"{tmp_path}/texts", "--source-ratio", "a=0.5", "--out", f"{tmp_path}/corpus"])
    rows = spark.read.parquet(f"{tmp_path}/corpus").collect()
    assert sorted(r.split for r in rows) == ["train"] * 9 + ["val"] * 2
    assert all(r.block.endswith("\n<eos>") for r in rows)
    main(["release", f"{tmp_path}/texts", "--out", f"{tmp_path}/manifest"])
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/manifest").collect()]
    assert [x["file"] for x in lines] == ["a.txt"]


def test_small_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 3.0, 2.0, 0.1, 1.0, 5.0)], "step int, train_loss double, val_loss double, lr double, mfu double, time double")
    for _ in range(2):
        src.append_results(rows, f"{tmp_path}/run/results.csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/run/results.csv").count() == 2
    assert src.keep_previous(spark, f"{tmp_path}/run") and not src.keep_previous(spark, f"{tmp_path}/run")
    assert (tmp_path / "run.old").exists()
    (tmp_path / "p.txt").write_text("from a file")
    assert src.read_prompt(spark, f"FILE:{tmp_path}/p.txt").first().text.strip() == "from a file"
    assert src.read_prompt(spark, "as given").first().text == "as given"
    src.write_report(rows, f"{tmp_path}/report", "Runs", ["step", "val_loss"], ["step"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert "| 0 | 2.0 |" in lines and "# Runs" in lines
    blocks = spark.createDataFrame([(i, f"b{i}") for i in range(5)], "id int, block string")
    src.write_blocks(blocks, f"{tmp_path}/blocks", ["id"])
    assert [r.block for r in src.read_blocks(spark, f"{tmp_path}/blocks").collect()] == [f"b{i}" for i in range(5)]
