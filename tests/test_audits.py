"""Audits, artifacts, guards and configuration."""

import hashlib
import os.path

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from attestor.functions import config
from attestor.operators import audits
from attestor.sources import artifacts


def test_containment_is_that_of_normpath(spark):
    names = [None, "", "/", "/a", ".", "..", "a", "a/..", "a/../..", "../a", "a/../../a", "./a//b/../../..", "a/./..//b", "..a/b", "a/b/../../c", "..//", " "]
    want = {n: bool(n) and not n.startswith("/") and os.path.normpath(n).split("/")[0] != ".." for n in names}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", audits.contained(F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in rows} == want


def test_models_and_bundles_are_pinned(spark, tmp_path):
    df = VectorAssembler(inputCols=["id", "y"], outputCol="features").transform(spark.range(40).withColumn("y", F.col("id") * 0.5))
    model = RandomForestRegressor(labelCol="y", numTrees=3, seed=1).fit(df)
    path = str(tmp_path / "forest")
    pin = artifacts.save_model(model, path)
    again = artifacts.load_model(spark, path, RandomForestRegressionModel, pin.upper(), features=2)
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in model.transform(df).collect()]
    with pytest.raises(ValueError, match="features"):
        artifacts.load_model(spark, path, RandomForestRegressionModel, pin, features=3)
    part = next(p for p in (tmp_path / "forest").rglob("part-*") if not p.name.startswith("."))
    part.write_bytes(part.read_bytes() + b"\n")
    part.with_name(f".{part.name}.crc").unlink()  # or the local file system itself would refuse to read it
    with pytest.raises(ValueError, match="digest"):
        artifacts.load_model(spark, path, RandomForestRegressionModel, pin)
    (tmp_path / "b").mkdir()
    for name in ("one.bin", "two.bin", "Extra.bin"):
        (tmp_path / "b" / name).write_text(name)
    pins = [("one.bin", hashlib.sha256(b"one.bin").hexdigest().upper()), ("two.bin", "0" * 64), ("gone.bin", "0" * 64)]
    got = artifacts.verify_bundle(spark, str(tmp_path / "b"), spark.createDataFrame(pins, "name string, digest string")).collect()
    assert {tuple(r) for r in got} == {("one.bin", "intact"), ("two.bin", "drift"), ("gone.bin", "missing"), ("extra.bin", "not_pinned")}


def test_empty_arms_and_indexes(spark):
    none = spark.createDataFrame([], "i long, k string, v string")
    one = spark.createDataFrame([(0, "a", "x"), (2, "a", None)], "i long, k string, v string")
    got = {r.rule: r.broken for r in audits.cache_problems(one, none, "i", ["k"], ["k", "v"]).collect()}
    assert got == {"candidate_gap": 1, "candidate_repeated_key": 1, "zero_gap": 0, "zero_repeated_key": 0, "only_candidate": 2, "only_zero": 0}
    rows = audits.index_problems(none.select("k", "v", "i"), "k", "v", "i", {"en": 2}, 1).collect()
    assert {tuple(r) for r in rows} == {("count", "en", 0, 2), ("empty_fold", "0", 0, 1)}


def test_yaml_and_parents(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nroot: ${PLACE}\n")
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/run.yml").write_text("extends: base.yaml\na: {y: 3}\n")
    (tmp_path / "none.yaml").write_text("")
    assert config.load(tmp_path / "deep/er/run.yml", {"PLACE": "here"}) == {"a": {"x": 1, "y": 3}, "root": "here"}
    assert config.load(tmp_path / "none.yaml") == {}


def test_path_findings_written_out(spark):
    """What must not be public by its path, with every suffix listed here again."""
    from attestor.operators import findings

    want = {f"a/x{s}": ["binary archive"] for s in (".7z", ".bz2", ".docker", ".img", ".ova", ".rar", ".tar", ".tgz", ".vhd", ".vhdx", ".xz", ".zip", ".tar.gz", ".ZIP.old")}
    want |= {f"a/x{s}": ["model weight"] for s in (".ckpt", ".engine", ".mmap", ".onnx", ".pt", ".pth", ".safetensors")}
    want |= {"demo/data/a_evidence_registry.json": [], "other/data/a_evidence_registry.json": ["forbidden path segment"], "a/b.log": ["runtime log"], "a/b.log.txt": [], "cloudflared": ["runtime log"]}
    want |= {"docs/receipt.md": ["raw receipt"], "docs/raw-receipts_2.md": ["raw receipt"], "docs/receiptbook.md": [], ".zip": [], "a\\TMP\\b": ["forbidden path segment"], ".pytest-x/b": ["scratch path"]}
    want |= {".pt": ["scratch path"], "a/..tar": [], None: []}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r.path: r.found for r in df.select("path", findings.path_findings(df.path).alias("found")).collect()}
    assert got == want


def test_content_findings_written_out(spark):
    from attestor.operators import findings

    want = {"see https://a-b.TryCloudflare.com/x": ["tunnel URL", "tunnel host"], "at x.ngrok.io.": ["tunnel host"], "ngrok is a tool": [], "in /home/me/x": ["private absolute path"], r"C:\Users\me": ["private absolute path"], "a/home/b": ["private absolute path"]}
    want |= {"sk-" + "a1" * 10: ["secret-like material"], "-----BEGIN PRIVATE KEY-----": ["secret-like material"], "aws_secret_access_key = x": ["secret-like material"], "task-list": [], "é" * 60: ["oversized"], None: []}
    df = spark.createDataFrame([(p,) for p in want], "text string")
    got = {r.text: r.found for r in df.select("text", findings.content_findings(df.text, 100).alias("found")).collect()}
    assert got == want
