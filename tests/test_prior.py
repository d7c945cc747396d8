"""The prior: regions of views, scores out of fold, thresholds by a plain version, release and load."""

import json
from collections import defaultdict

import numpy as np
import pytest

from attestor.functions import kernels, regions
from attestor.operators import prior

SMALL = {"numTrees": 5, "maxDepth": 4}


def discs(n=12, side=16):
    r = np.random.default_rng(0)
    for i in range(n):
        y, x = np.mgrid[:side, :side]
        mask = (y - r.integers(5, 11)) ** 2 + (x - r.integers(5, 11)) ** 2 < 16
        image = np.where(mask[..., None], (90, 50, 40), (220, 180, 160)) + r.integers(-6, 6, (side, side, 3))
        yield i, f"g{i // 2}", np.clip(image, 0, 255).astype(np.uint8), mask


def test_prior(spark, tmp_path):
    made = list(discs())
    rows = [(i, g, image.ravel().tolist(), mask.astype(int).ravel().tolist()) for i, g, image, mask in made]
    df = spark.createDataFrame([*rows, (90, "x", None, None), (91, "x", [1, 2], [1])], "id long, group_key string, pixels array<int>, mask array<int>").repartition(3)
    data = prior.region_rows(df, 16, 16, 9).cache()
    got = defaultdict(dict)
    for r in data.collect():
        got[r.id, r.view][r.region] = r
    assert set(got) == {(i, v) for i in range(12) for v in ("clean", "gaussian_noise")}
    for i, _, image, mask in made[:3]:
        for view in ("clean", "gaussian_noise"):
            seen = image if view == "clean" else kernels.corrupt(image, view, i)
            label = regions.superpixels(seen, 9)
            want = regions.described(seen, label)
            assert len(got[i, view]) == len(want)
            for k, r in got[i, view].items():
                assert np.allclose(r.features, want[k]) and (r.n, r.inside) == ((label == k).sum(), mask[label == k].sum())
    scored = prior.out_of_fold(data, folds=3, **SMALL).cache()
    found = scored.collect()
    assert len(found) == data.count()
    hits = [(r.inside / r.n > 0.5) == (r.score > 0.5) for r in found]
    assert np.mean(hits) > 0.85  # of images that no forest has seen
    table = {r.threshold: r for r in prior.thresholds(scored, least=0.9).collect()}
    assert set(table) == set(prior.GRID)
    for t, r in table.items():
        by_view = []
        for view in ("clean", "gaussian_noise"):
            figures = []
            for i in range(12):
                mine = [x for x in found if x.id == i and x.view == view]
                on, hit = sum(x.n for x in mine if x.score >= t), sum(x.inside for x in mine if x.score >= t)
                mask = sum(x.inside for x in mine)
                figures.append((hit / mask, on / 256, 2 * hit / (mask + on)))
            by_view.append(np.median(figures, axis=0))
        a, b, d = min(x[0] for x in by_view), max(x[1] for x in by_view), min(x[2] for x in by_view)
        assert np.allclose((r.coverage, r.support, r.dice), (a, b, d)) and r.feasible == (a >= 0.9 and b <= 0.6)
    chosen = [r for r in table.values() if r.selected]
    assert len(chosen) == 1 and chosen[0].feasible and chosen[0].dice == max(r.dice for r in table.values() if r.feasible)
    assert [r.threshold for r in prior.thresholds(scored, least=1.1).where("selected").collect()] == [min((-r.dice, t) for t, r in table.items())[1]]
    model = prior.fit(data, **SMALL)
    record = prior.release(model, chosen[0].asDict(), str(tmp_path / "p"))
    loaded, threshold = prior.load(spark, str(tmp_path / "p"), json.dumps(record))
    assert threshold == chosen[0].threshold and loaded.getNumTrees == 5
    for change in ({"schema_version": "prior.v0"}, {"features": regions.NAMES[:-1]}, {"threshold": 1.0}, {"threshold": None}, {"digest": "0" * 64}):
        with pytest.raises(ValueError):
            prior.load(spark, str(tmp_path / "p"), json.dumps(record | change))
    with pytest.raises(Exception, match="(?i)exist"):
        prior.release(model, chosen[0].asDict(), str(tmp_path / "p"))


def test_out_of_fold_however_the_work_is_dealt(spark):
    from pyspark.sql import functions as F

    from attestor.operators import forest

    r = np.random.default_rng(1)
    x = r.random((300, 3))
    y = np.where(x[:, 0] > 0.5, 0.9, 0.1) * (x[:, 1] > 0.3)
    df = spark.createDataFrame([(i, i % 3, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, fold int, x array<double>, label double")
    shape = {"numTrees": 6, "maxDepth": 5, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.75", "subsamplingRate": 0.65, "seed": 7}
    whole = {p.id: p.score for p in forest.scored(df.repartition(2), ["id"], "x", "label", "fold", 3, 3, **shape).collect()}
    parts = {p.id: p.score for p in forest.scored(df.repartition(5), ["id"], "x", "label", "fold", 3, 3, most=40, **shape).collect()}
    assert whole.keys() == parts.keys() == set(range(300))
    assert all(abs(whole[i] - parts[i]) < 1e-12 for i in whole)  # large nodes divided by all tasks, or all in one
    assert np.mean([(whole[i] - y[i]) ** 2 for i in whole]) < 0.1 * np.var(y)
    hidden = df.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))  # a fold's own labels say nothing
    again = {p.id: p.score for p in forest.scored(hidden, ["id"], "x", "label", "fold", 3, 3, **shape).collect()}
    assert all(abs(again[i] - whole[i]) < 1e-12 for i in whole if i % 3 == 1) and any(again[i] != whole[i] for i in whole if i % 3 != 1)
    with pytest.raises(Exception, match="no rows of other folds"):
        forest.scored(df.where("fold = 1"), ["id"], "x", "label", "fold", 3, 3, **shape).collect()


def test_grown_tree_takes_the_best_splits(spark):
    from attestor.operators import forest

    r = np.random.default_rng(2)
    shape = forest.Shape(2, 3, 1, 4, 3, "1.0", 0.65, 5)
    rows = np.zeros(120, np.dtype([("bins", "u1", (3,)), ("weight", "u1"), ("label", "<i8")]))
    rows["bins"], rows["weight"], rows["label"] = r.integers(0, 9, (120, 3)), r.integers(1, 3, 120), r.integers(0, forest.ONE, 120)
    tree = {n["at"]: n for n in forest.grown(shape, 0, 0, 1, rows)}

    def loss(x):
        y, w = x["label"] / forest.ONE, x["weight"]
        return (w * (y - np.average(y, weights=w)) ** 2).sum() if len(x) else 0.0

    def check(at, x):
        n = tree.pop(at)
        assert abs(n["value"] - np.average(x["label"] / forest.ONE, weights=x["weight"])) < 1e-9
        cuts = [(x["bins"][:, f] <= c, f, c) for f in range(3) for c in range(31)]
        fair = [loss(x[m]) + loss(x[~m]) for m, _, _ in cuts if min(x["weight"][m].sum(), x["weight"][~m].sum()) >= 3]
        if n["feature"] < 0:
            assert at >= 16 or not fair or min(fair) > loss(x) - 1e-9
            return
        low = x["bins"][:, n["feature"]] <= n["cut"]
        assert abs(loss(x[low]) + loss(x[~low]) - min(fair)) < 1e-9
        check(2 * at, x[low])
        check(2 * at + 1, x[~low])

    check(1, rows)
    assert not tree


def test_calibrated_prior_needs_no_figures_of_all_nodes(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    from attestor.plans import registry

    monkeypatch.setattr(RandomForestRegressor, "fit", lambda *a: pytest.fail("each pass of such a fit shuffles all nodes' bins from each part"))
    rows = registry.QUERIES["calibrated_prior"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.threshold for r in rows) == prior.GRID and sum(r.selected for r in rows) == 1
