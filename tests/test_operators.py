"""Operators on planted cases that the tables don't hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import config, digests, registry, scalars
from attestor.operators import evidence, gates, graphs, ranking, resampling, similarity, splits


def test_near_pairs_against_brute_force(spark):
    r = random.Random(1)
    base = [r.getrandbits(62) for _ in range(40)]
    codes = base + [b ^ (1 << r.randrange(62)) ^ (1 << r.randrange(62)) for b in base for _ in range(3)] + base[:5]
    df = spark.createDataFrame(list(enumerate(codes)), "n long, x long")
    got = {(x.a, x.b, x.distance) for x in similarity.near_pairs(df, "n", "x", 63, 4).collect()}
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and (a ^ b).bit_count() <= 4}
    assert got == want and len(want) > 100


def test_components_of_chains_and_blanks(spark):
    rows = [(i, f"p{i // 2}", f"q{(i + 1) // 2}") for i in range(31)] + [(100, " ", None), (101, "", ""), (102, None, None)]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    got = {x.n: x.component for x in graphs.shared_key_components(df, "n", ["a", "b"]).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 101, 102: 102}


def test_splits_do_not_depend_on_partitioning(spark):
    sizes = [(f"g{i}", 1 + i % 7) for i in range(200)]
    df = spark.createDataFrame(sizes, "grp string, n long")
    one = {(r.grp, r.split) for r in splits.split_groups(df, {"a": 0.7, "b": 0.3}, 3).collect()}
    two = {(r.grp, r.split) for r in splits.split_groups(df.orderBy(F.rand(1)).repartition(7), {"a": 0.7, "b": 0.3}, 3).collect()}
    assert one == two
    n = dict(sizes)
    total = sum(n.values())
    assert abs(sum(n[g] for g, s in one if s == "a") - 0.7 * total) <= 7
    folds = splits.fold_groups(df, 5, 205).collect()
    by = [sum(n[r.grp] for r in folds if r.fold == k) for k in range(5)]
    assert max(by) - min(by) <= 7
    with pytest.raises(ValueError):
        splits.split_groups(df, {"a": 0.5}, 1)


def test_ranking_edges(spark):
    df = spark.createDataFrame([("one", 0.5, 1), ("one", 0.7, 1), ("tie", 1.0, 0), ("tie", 1.0, 1), ("flat", 2.0, 0)], "g string, s double, y int")
    a = {r.g: r.auroc for r in ranking.auroc(df, ["g"], "s", F.col("y") == 1).collect()}
    assert a == {"one": None, "tie": 0.5, "flat": None}
    p = {r.g: r.auprc for r in ranking.average_precision(df, ["g"], "s", F.col("y") == 1).collect()}
    assert p == {"one": 1.0, "tie": 0.5, "flat": None}
    s = {r.g: r.spearman for r in ranking.spearman(df, ["g"], "s", "y").collect()}
    assert s["flat"] == 0.0 and s["tie"] == 0.0
    o = ranking.overlap(spark.createDataFrame([("e", False, False), ("f", True, False)], "g string, p boolean, q boolean"), ["g"], F.col("p"), F.col("q"), strict=True)
    assert {r.g: (r.dice, r.precision, r.recall) for r in o.collect()} == {"e": (1.0, 1.0, 1.0), "f": (0.0, 0.0, 0.0)}


def test_gates(spark):
    s = spark.createDataFrame([("overall", "m", 0.5), ("clean", "m", 0.4), ("noise", "m", 0.1), ("overall", "x", float("nan"))], "scope string, metric string, value double")
    g = spark.createDataFrame([("a", "m", "overall", ">=", 0.5), ("b", "m", "each", ">", 0.1), ("c", "m", "each", "<=", 0.4), ("d", "x", "overall", "<=", 1.0), ("e", "none", "overall", ">", 0.0)], "gate string, metric string, scope string, comparison string, required double")
    assert {r.gate: r.status for r in gates.evaluate(s, g).collect()} == {"a": "passed", "b": "failed", "c": "passed", "d": "blocked", "e": "blocked"}
    assert len(gates.RANKING_GATES) == 15


def test_rules_of_gates(spark):
    """Limits below the baseline, regressions from clean, and redundancy, by values written out."""
    base = [("clean", "median_auroc", 0.9), ("blur", "median_auroc", 0.86), ("gaussian_noise", "median_auroc", 0.8), ("blur", "fallback_rate", 0.3), ("clean", "fallback_rate", 0.5)]
    more = {"median_spearman_vs_old_proxy": 0.96, "median_auroc_delta": 0.0, "median_mass_concentration_delta": -0.1}

    def of(baseline, **k):
        rows = base + [("overall", m, v) for m, v in (more | k).items()] + ([("overall", "fallback_baseline", baseline)] if baseline is not None else [])
        s = gates.derived(spark.createDataFrame(rows, "scope string, metric string, value double"))
        return {(r.scope, r.metric): round(r.value, 6) for r in s.collect() if r.metric in ("auroc_regression", "fallback_over_limit", "redundant")}

    assert of(0.5) == {("blur", "auroc_regression"): 0.04, ("gaussian_noise", "auroc_regression"): 0.1, ("blur", "fallback_over_limit"): -0.05, ("clean", "fallback_over_limit"): 0.15, ("overall", "redundant"): 1.0}
    assert of(0.9, median_auroc_delta=0.01)[("clean", "fallback_over_limit")] == 0.05
    assert of(0.1)[("blur", "fallback_over_limit")] == float("inf")
    assert of(None, median_auroc_delta=0.01) == {("blur", "auroc_regression"): 0.04, ("gaussian_noise", "auroc_regression"): 0.1, ("overall", "redundant"): 0.0}
    assert {g for g, *_ in gates.SCREEN_GATES} == {"median_auroc_delta", "paired_auroc_delta_ci_lower", "coverage_each_corruption", "support_area_ratio", "fallback_each_corruption", "invalid_border", "mass_concentration_delta", "corruption_auroc_regression", "old_proxy_redundancy"}


def test_bootstrap(spark):
    values = np.random.default_rng(1).normal(2, 1, 60)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, v double")
    r = resampling.bootstrap_median(df, "k", "v", 300, 5).first()
    n = resampling.numpy_bootstrap_median(values, 2000, 5)
    assert r.estimate == pytest.approx(n["estimate"]) and abs(r.lower - n["lower"]) < 0.25 and abs(r.upper - n["upper"]) < 0.25
    with pytest.raises(ValueError):
        resampling.bootstrap_median(df.limit(1), "k", "v", 300, 5)


def test_digests(spark):
    import hashlib
    import struct

    df = spark.createDataFrame([(3, 5, b"\x00\xff\x10")], "h int, w int, px binary")
    r = df.select(digests.image_digest(F.col("h"), F.col("w"), F.col("px")).alias("a"), digests.image_digest(F.col("h"), F.col("w"), F.col("px"), 1).alias("m"), digests.packed_digest([F.col("h"), F.col("w")], F.col("px")).alias("b"), digests.condition_seed(F.lit("p"), F.lit("q")).alias("s")).first()
    assert r.a == hashlib.sha256(b"3x5x3|\x00\xff\x10").hexdigest() and r.m == hashlib.sha256(b"3x5|\x00\xff\x10").hexdigest()
    assert r.b == hashlib.sha256(struct.pack("<qq", 3, 5) + b"\x00\xff\x10").hexdigest()
    assert int(r.s) == int.from_bytes(hashlib.sha256(b"p|q").digest()[:8], "big")


def test_protected_and_ids(spark):
    rows = [(" Test-V3", True), ("ph2", True), ("a/PH2-b", True), ("train", False), (None, False), ("phone2", False)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    assert df.where(scalars.is_protected(F.col("s")) != F.col("want")).count() == 0
    stems = spark.createDataFrame([("a/b.c.png", "b.c"), ("x", "x"), ("", None)], "p string, want string")
    assert stems.where(~scalars.path_stem(F.col("p")).eqNullSafe(F.col("want"))).count() == 0


def test_violations_and_status(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "k long, v double")
    got = {(r.k, r.rule) for r in evidence.violations(df, "k", {"positive": F.col("v") > 0, "known": F.col("v").isNotNull()}).collect()}
    assert got == {(2, "positive"), (2, "known"), (3, "positive")}
    s = df.select("k", evidence.first_status((F.col("v").isNull(), "missing"), (F.col("v") < 0, "bad"), done="ready").alias("s"))
    assert {r.k: r.s for r in s.collect()} == {1: "ready", 2: "missing", 3: "bad"}
    c = evidence.clauses(spark.createDataFrame([(1, "It works. It does not scale; nothing else!  ")], "k long, t string"), "k", "t").collect()
    assert [x.negated for x in sorted(c, key=lambda x: x.pos)] == [False, True, False]


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "p": "${HOME_DIR:-/srv}/x"}')
    (tmp_path / "top.json").write_text('{"extends": "base.json", "a": {"y": 3}}')
    assert config.load(tmp_path / "top.json", {}) == {"a": {"x": 1, "y": 3}, "p": "/srv/x"}
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError):
        config.load(tmp_path / "loop.json")
    rules = {"a.x": (float, 0, 1), "b": (int, None, None), "c": (float, None, None)}
    assert config.problems({"a": {"x": 2}, "c": True}, rules) == ["a.x: out of range", "b: missing", "c: not float"]


def test_registry():
    r = registry.Registry("thing", {"a": len})
    r.add("b", max)
    assert list(r) == ["a", "b"]
    with pytest.raises(KeyError, match="a, b"):
        r["c"]
    with pytest.raises(ValueError):
        r.add("a", len)


def test_links_that_are_stars_take_no_round(spark):
    from attestor.operators.graphs import stars

    def rounds(links):
        cuts = []
        edges = stars(spark.createDataFrame(links, "u long, v long"), lambda e: cuts.append(1) or e.localCheckpoint())
        return {(r.u, r.v) for r in edges.collect()}, len(cuts)

    assert rounds([(5, 1), (1, 7), (9, 3), (4, 4), (7, 1)]) == ({(5, 1), (7, 1), (9, 3)}, 1)
    assert rounds([(4, 4)]) == (set(), 1)
    found, many = rounds([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31)])
    assert found == {(i, 0) for i in range(1, 21)} | {(31, 30), (32, 30)} and many > 1
