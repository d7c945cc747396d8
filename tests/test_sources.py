"""Sources, sinks and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attestor.sources import readers, writers
from attestor.streaming import journal

from .compare import SF


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿split,id,path\ntrain,007,a b.png\n,8,\"c,d\"\n")
    df = readers.manifest(spark, str(tmp_path / "m.csv"), ["id", "split", "group"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("007", "train", None), ("8", None, None)]
    (tmp_path / "bad.csv").write_text("id\n1\n")
    (tmp_path / "none.csv").write_text("split\n")
    for name in ("bad.csv", "none.csv"):
        with pytest.raises(ValueError):
            readers.manifest(spark, str(tmp_path / name), [])


def test_files_archives_and_caches(spark, tmp_path):
    import hashlib

    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/X.PNG").write_bytes(b"xyz")
    index = readers.file_index(spark, str(tmp_path / "d")).collect()
    assert [(r.name, r.length, r.digest) for r in index] == [("x.png", 3, hashlib.sha256(b"xyz").hexdigest())]
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr(f"in/{i}.txt", b"one")
            z.writestr("both.txt", b"two")
    wanted = spark.createDataFrame([("0.txt",), ("both.txt",), ("gone.txt",)], "name string")
    found, missing, twice = readers.selected_members(readers.zip_members(spark, str(tmp_path)), wanted)
    assert [bytes(r.content) for r in found.collect()] == [b"one"]
    assert [r.name for r in missing.collect()] == ["gone.txt"] and [r.name for r in twice.collect()] == ["both.txt"]


def test_json(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"schema_version": "1", "rows": [{"id": "a", "split": "train"}, {"id": "b", "split": "test"}]}))
    assert [r.id for r in readers.index_rows(spark, str(tmp_path / "i.json"), "id:string,split:string", "train").collect()] == ["a"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1.json").write_text('{"arm": "x", "seed": 1}')
    (tmp_path / "r/2.json").write_text('{"arm": ')
    rows = readers.receipts(spark, str(tmp_path / "r"), "arm string, seed long").collect()
    assert sorted(r._corrupt_record is None for r in rows) == [False, True]
    (tmp_path / "t.tex").write_text("TEST & one & 0.5 \\\\\nTEST & two & 0.7 \\\\\n")
    t = readers.tex_rows(spark, str(tmp_path / "t.tex"), r"TEST & (\w+) & ([0-9.]+)", ["name", "dice"]).orderBy("pos").collect()
    assert [(r.name, r.dice) for r in t] == [("one", "0.5"), ("two", "0.7")]


def test_masks_and_files(spark):
    m = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 0, 0.0), ("a", 0, 1, 0.0)], "k string, y int, x int, value double")
    assert {r.x: r.value for r in readers.merged_masks(m, "k", "mean").collect()} == {0: 0.5, 1: 0.0}
    assert {r.x: r.value for r in readers.merged_masks(m, "k", "union").collect()} == {0: 1.0, 1: 0.0}
    f = readers.required_files(spark.createDataFrame([("s", "b", "m"), ("s", "a", "m")], "source string, image string, mask string")).first()
    assert (f.images, f.masks) == (["a", "b"], ["m"])


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.canonical_json({"x": float("nan")})
    assert writers.canonical_json({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}\n'
    with pytest.raises(ValueError):
        writers.parse_unique('{"a": 1, "a": 2}')
    p = tmp_path / "x.json"
    assert writers.publish(p, b"1") == writers.publish(p, b"1")
    with pytest.raises(ValueError):
        writers.publish(p, b"2")
    writers.publish(p, b"2", replace=True)
    assert p.read_bytes() == b"2" and [x.name for x in tmp_path.iterdir()] == ["x.json"]
    df = spark.createDataFrame([(2, "b_"), (1, "a")], "k long, v string")
    assert writers.write_rows(df, tmp_path / "r.json") == writers.write_rows(df.repartition(3), tmp_path / "r.json")
    assert "b\\_ \\\\" in writers.tex_table(df, ["k", "v"], "100%")
    for i in range(3):
        writers.append_event(tmp_path / "j", "c", "start", {"i": i})
    j = spark.read.schema("component string, event string, recorded_at_ns long, payload struct<i:long>").json(str(tmp_path / "j"))
    assert journal.latest(j, "component", "recorded_at_ns").first().payload.i == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in/e"))
    s = journal.event_stream(spark, str(tmp_path / "in/e"))
    q = journal.sessions(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = journal.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert 0 < done.count() <= batch.count() and done.exceptAll(batch).where("n = 0").count() == 0
    key = ["user_id", "opened", "closed", "n"]
    assert done.select(key).exceptAll(batch.select(key)).count() == 0


def test_generations(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 3), (1, 2), (2, 5)], "session long, generation long").coalesce(1).write.parquet(str(tmp_path / "g"))
    s = spark.readStream.schema("session long, generation long").parquet(str(tmp_path / "g"))
    q = journal.guard_generations(s).writeStream.format("memory").queryName("guarded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.session, r.generation, r.accepted) for r in spark.table("guarded").collect()} == {(1, 1, True), (1, 3, True), (1, 2, False), (2, 5, True)}
    batch = spark.read.parquet(str(tmp_path / "g"))
    assert {(r.session, r.generation) for r in journal.current_generation(batch, "session", "generation").collect()} == {(1, 3), (2, 5)}
