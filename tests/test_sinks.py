import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import text as src
from corpusloom.sources import token_sink, zstd_lines

READ = "part-[0-9]*.bin"


def tokens_of(spark, path):
    return [t for p in src.read_tokens(spark, path).orderBy("source", "part").collect() for t in p.ids]


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


def test_a_write_takes_the_place_of_all_earlier_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = spark.createDataFrame([(i, [i, 65535, 7]) for i in range(400)], "id int, ids array<int>")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert src.write_tokens(rows, path, ["id"]) == 1200
        wide = files(path)
        assert len(wide) == 8 and tokens_of(spark, path) == [t for i in range(400) for t in (i, 65535, 7)]
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert src.write_tokens(rows.where("id < 50"), path, ["id"]) == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(files(path)) == 4 and not set(files(path)) & set(wide) - {token_sink.LISTED}
    assert tokens_of(spark, path) == [t for i in range(50) for t in (i, 65535, 7)]


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    """A task dies in the middle: what it and the others wrote goes, and the files of the write before stay the data."""
    path = str(tmp_path / "tokens")
    rows = spark.createDataFrame([(i, [i]) for i in range(100)], "id int, ids array<int>")
    src.write_tokens(rows, path, ["id"])
    held = {f: (tmp_path / "tokens" / f).read_bytes() for f in files(path)}

    @F.udf("array<int>")
    def dies(i):
        if i == 77:
            raise RuntimeError("killed")
        return [i, i]

    for bad in (rows.withColumn("ids", dies("id")), rows.withColumn("ids", F.when(F.col("id") == 50, F.array(F.lit(70000))).otherwise(F.col("ids")))):
        with pytest.raises(Exception, match="killed|beyond 16 bits"):
            src.write_tokens(bad, path, ["id"])
        assert {f: (tmp_path / "tokens" / f).read_bytes() for f in files(path)} == held
        assert tokens_of(spark, path) == list(range(100))


def test_files_that_a_dead_driver_left_are_no_data(spark, tmp_path):
    path = tmp_path / "tokens"
    rows = spark.createDataFrame([(i, [i]) for i in range(20)], "id int, ids array<int>")
    src.write_tokens(rows, str(path), ["id"])
    (path / "part-000099-dead.bin").write_bytes(b"\x01\x00")  # moved in, but the list was not yet replaced
    (path / "_job-dead").mkdir()
    (path / "_job-dead" / "000000-1.bin").write_bytes(b"\x01\x00")
    assert tokens_of(spark, str(path)) == list(range(20))
    src.write_tokens(rows.where("id < 5"), str(path), ["id"])
    assert tokens_of(spark, str(path)) == list(range(5)) and not (path / "_job-dead").exists()
    assert {x["name"] for x in json.loads((path / token_sink.LISTED).read_text())} == set(files(path)) - {token_sink.LISTED}


def test_odd_rows_of_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2]), (2, None), (3, []), (3, [3]), (None, [0])], "id int, ids array<int>")
    assert src.write_tokens(rows, str(tmp_path / "odd"), ["id"]) == 4
    assert tokens_of(spark, str(tmp_path / "odd")) == [0, 1, 2, 3]
    assert src.write_tokens(rows.limit(0), str(tmp_path / "odd"), ["id"]) == 0 and tokens_of(spark, str(tmp_path / "odd")) == []


def frames(rng, lines, checksum):
    """The lines' bytes, cut anywhere into frames of any kind, with frames between them that are to be skipped."""
    import zstandard

    raw, out, at = b"".join(lines), [], 0
    while at < len(raw) or not out:
        piece = raw[at : at + rng.choice([0, 1, 5, 40, 400, 3000])]
        at += len(piece)
        if rng.random() < 0.2:
            out.append(zstd_lines.SKIPPABLE.to_bytes(4, "little") + (6).to_bytes(4, "little") + b"\x28\xb5\x2f\xfd!!")
        if rng.random() < 0.5:
            out.append(zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=rng.random() < 0.5).compress(piece))
        else:
            stream = zstandard.ZstdCompressor(write_checksum=checksum).compressobj()
            out.append(stream.compress(piece) + stream.flush())
    return b"".join(out)


def test_frames_are_read_by_several_tasks_and_lines_are_stitched(spark, tmp_path):
    rng = random.Random(61)
    wanted = {}
    for k in range(6):
        lines = [("ä" * rng.randint(0, 9) + f"{k}-{i}" + "x" * rng.choice([0, 3, 2000])).encode() + rng.choice([b"\n", b"\r\n", b"\n\n"]) for i in range(rng.choice([0, 1, 300]))]
        if k % 2 and lines:
            lines[-1] = lines[-1].rstrip(b"\r\n")  # no line end at the end
        (tmp_path / f"{k} a.zst").write_bytes(frames(rng, lines, k % 3 == 0))
        wanted[f"{k} a.zst"] = [x for x in b"".join(lines).decode().replace("\r\n", "\n").split("\n") if x.strip()]
    (tmp_path / "none.zst").write_bytes(b"")
    for size in (1, 700, 1 << 26):
        groups = zstd_lines.frame_groups(spark, str(tmp_path), "*.zst", size).collect()
        assert len(groups) > 50 if size == 1 else len(groups) == 6 if size > 1000 else True
        got = {}
        for r in sorted(zstd_lines.read_zstd_lines(spark, str(tmp_path), group_bytes=size).collect(), key=lambda r: (r.path, r.line_no)):
            got.setdefault(r.path.rsplit("/", 1)[-1].replace("%20", " "), []).append(r.value)
        assert got == {k: v for k, v in wanted.items() if v}, size
        assert zstd_lines.read_zstd_lines(spark, str(tmp_path), group_bytes=size).select("path", "line_no").distinct().count() == sum(map(len, wanted.values()))


def test_a_broken_frame_ends_its_group(spark, tmp_path):
    import zstandard

    whole = [zstandard.compress(f"{i} one\n{i} two\n".encode()) for i in range(4)]
    broken = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(b"lost " * 50 + b"\nlost\n"))
    broken[-1] ^= 1
    (tmp_path / "x.zst").write_bytes(b"".join([*whole[:2], bytes(broken), *whole[2:]]))
    got = [r.value for r in zstd_lines.read_zstd_lines(spark, str(tmp_path), strict=False).orderBy("line_no").collect()]
    assert got[:4] == ["0 one", "0 two", "1 one", "1 two"] and "2 one" not in got
    with pytest.raises(Exception, match="[Cc]hecksum|Zstd"):
        zstd_lines.read_zstd_lines(spark, str(tmp_path)).collect()
    (tmp_path / "y.zst").write_bytes(whole[0] + whole[1][:-3])  # cut off: its frames can't be told apart, so they are one group
    some = zstd_lines.read_zstd_lines(spark, str(tmp_path), "y.zst", group_bytes=1, strict=False)
    assert [r.value for r in some.orderBy("line_no").collect()][:2] == ["0 one", "0 two"]


def test_counts_come_with_the_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x", "n": 1}\nnot json\n{"q": "y", "n": "z"}\n\n{"q": "w"}\n', encoding="utf-8")
    rows, seen = src.observed_rows(src.parsed_rows(spark, str(tmp_path), "q string, n int"))
    assert sorted(r.q for r in rows.collect()) == ["w", "x"]
    assert seen.get == {"n": 4, "n_bad": 2}
    assert str(rows._jdf.queryExecution().executedPlan()).count("Scan text") == 1


def test_replayed_batches_of_metrics_add_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "metrics"), "arm string, step int, val_loss double"
    write = src.metric_sink(path)
    batches = [[("a", 0, 2.0), ("a", 1, 1.5), ("a", 1, 1.5)], [("a", 2, 1.2), ("b", 0, 3.0)], [("a", 2, 1.1)]]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), n)
    write(spark.createDataFrame(batches[1], schema), 1)  # run again after a restart
    got = src.read_metrics(spark, path)
    assert got.columns == ["arm", "step", "val_loss"]
    assert sorted(map(tuple, got.collect())) == [("a", 0, 2.0), ("a", 1, 1.5), ("a", 2, 1.1), ("b", 0, 3.0)]


def test_metrics_of_a_stream_survive_a_restart(spark, tmp_path):
    schema, path = "arm string, step int, val_loss double", str(tmp_path / "metrics")

    def run():
        rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = rows.writeStream.foreachBatch(src.metric_sink(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()

    for n in range(3):
        spark.createDataFrame([("a", n, float(n))], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run()
        commits = sorted(os.listdir(tmp_path / "cp" / "commits"))
        newest = max((c for c in commits if c.isdigit()), key=int)
        os.remove(tmp_path / "cp" / "commits" / newest)  # the driver died before it had noted the batch
        for crc in (tmp_path / "cp" / "commits").glob(f".{newest}.crc"):
            os.remove(crc)
        run()
    assert sorted(map(tuple, src.read_metrics(spark, path).collect())) == [("a", n, float(n)) for n in range(3)]


def test_strict_results_fail_on_cells_that_are_no_numbers(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "results.csv").write_text("step,train/loss,val/loss,lr,mfu,time\n0,1.0,2.0,0.1,0.2,3\n1,x,1.5,0.1,0.2,4\n", encoding="utf-8")
    assert [(r.arm, r.step, r.train_loss) for r in src.read_results(spark, str(tmp_path)).orderBy("step").collect()] == [("run", 0, 1.0), ("run", 1, None)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        src.read_results(spark, str(tmp_path), strict=True).collect()
