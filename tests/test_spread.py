"""Work over rasters grows with their contents, and is dealt over all cores although the table is one small file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import kernels, regions
from attestor.operators import prior, similarity
from attestor.plans import leakage, pixels, registry

from .compare import SF


@pytest.mark.parametrize("name", ["multiscale_map", "kernel_boundary_proxy", "kernel_superpixels"])
def test_all_cores_take_part(spark, name):
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_contents_are_compared_once(spark, tmp_path):
    once = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 60")
    for k, rows in enumerate((once, once.union(once.withColumn("vec_id", F.col("vec_id") + 1000)))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
    found = [leakage.crossing(leakage.records(spark, f"{tmp_path}/{k}")).collect() for k in range(2)]
    assert len(found[1]) == len({(r.a, r.b) for r in found[1]}) and len(found[1]) < 3 * len(found[0])
    for k in range(2):
        pairs = registry.QUERIES["refined_pairs"](spark, f"{tmp_path}/{k}").collect()
        r = registry.QUERIES["leakage_verified"](spark, f"{tmp_path}/{k}").first()
        listed = registry.QUERIES["near_dup_banded"](spark, f"{tmp_path}/{k}")
        train = {x.n: x.train for x in leakage.records(spark, f"{tmp_path}/{k}").collect()}
        assert r.near_candidates == sum(train[x.a] != train[x.b] for x in listed.collect())
        assert r.near_leaks == len(pairs) == len({(x.a, x.b) for x in pairs}) and all(train[x.a] != train[x.b] and x.a < x.b for x in pairs)


def test_similarity_of_small_rasters():
    r = np.random.default_rng(0)
    up, across = kernels.lanczos_weights(8, 64), kernels.lanczos_weights(6, 64)
    blurred = similarity.Blurred(8, 6, 64)
    for _ in range(10):
        g = r.integers(0, 256, (8, 6)).astype(float)
        h = np.clip(g + r.integers(-20, 20, g.shape), 0, 255)
        want = kernels.structural_similarity(up @ g @ across.T, up @ h @ across.T, lambda x: kernels.gaussian(x, 1.5, 5))
        assert np.isclose(blurred.similarity(g, h), want, rtol=0, atol=1e-10) and np.isclose(blurred.similarity(g, h, want - 1e-6, 7), want, rtol=0, atol=1e-10)
        assert blurred.similarity(g, h, want + 1e-6) is None


def test_bound_from_parts_is_never_below_the_similarity():
    r = np.random.default_rng(1)
    blurred = similarity.Blurred(8, 8, 64)
    told = []
    for k in range(200):
        g = r.integers(0, 256, (8, 8)).astype(float) if k % 2 else r.integers(90, 130, (8, 8)).astype(float)
        h = np.clip(g + (40 if k % 4 == 0 else r.integers(-60, 60, g.shape)), 0, 255)
        most, found = blurred.most(blurred.parts(g), blurred.parts(h)), blurred.similarity(g, h)
        told.append(most < 0.98)
        assert most >= found - 1e-9 and (not told[-1] or blurred.similarity(g, h, 0.98) is None)
    assert all(told[::4])  # brighter by 40: no place is compared


def test_pairs_of_one_tile_lie_together(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200").write.parquet(f"{tmp_path}/embeddings.parquet")
    contents = leakage.contents_of(leakage.records(spark, str(tmp_path)))
    assert contents.groupBy("block").count().agg(F.max("count")).first()[0] < 4 * leakage.BLOCK
    pairs = leakage.near_contents(contents)
    raw = {r.id: r.g for r in contents.collect()}
    assert all(r.ga == raw[r.a] and r.gb == raw[r.b] and r.n > 0 for r in pairs.collect())


def test_mean_shift_of_small_images_by_loops():
    r = np.random.default_rng(2)
    image = (r.integers(0, 3, (5, 7, 3)) * 12).astype(np.uint8)
    f = image.astype(float)
    want = f.copy()
    for y in range(5):
        for x in range(7):
            near = [f[v, u] for v in range(5) for u in range(7) if abs(v - y) <= 3 and abs(u - x) <= 3 and ((f[v, u] - f[y, x]) ** 2).sum() <= 18**2]
            want[y, x] = np.mean(near, axis=0)
    assert (regions.mean_shift(image, space=3, steps=1) == np.rint(want)).all()


def test_multiscale_of_an_odd_row(spark, tmp_path):
    spark.createDataFrame([(1, [0.5] * 64), (2, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = pixels.multiscale_map(spark, str(tmp_path)).collect()
    assert len(got) == 128 and {r.score for r in got if r.vec_id == 1} == {191.0} and {r.score for r in got if r.vec_id == 2} == {None}


def test_forests_of_folds_see_one_part_a_core(spark):
    rows = spark.range(200).selectExpr("id", "cast(id as string) group_key", "'clean' view", "0 region", f"transform(sequence(1, {len(regions.NAMES)}), i -> cast((id * i) % 7 as double)) features", "10L n", "id % 11 inside")
    scored = prior.out_of_fold(rows.repartition(40), folds=2, numTrees=1, maxDepth=1)
    assert scored.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and scored.count() == 200


def test_bounds_tell_what_is_similar_without_comparing(spark, monkeypatch):
    r = np.random.default_rng(3)
    blurred = similarity.Blurred(8, 8, 256)
    rows, told = [], 0
    for k in range(120):
        g = r.integers(20, 236, (8, 8)).astype(float)
        h = np.clip(g + (r.integers(-1, 2, g.shape) if k % 3 == 0 else r.integers(-24, 25, g.shape) if k % 3 == 1 else r.integers(-9, 10, g.shape)), 0, 255)
        found = blurred.similarity(g, h)
        low = blurred.fewest((g - h)[None], (blurred.floors(g) + blurred.floors(h))[None])[0]
        assert low <= found + 1e-9
        told += low >= 0.98
        rows.append((k, g.astype(int).ravel().tolist(), h.astype(int).ravel().tolist(), found >= 0.98))
    assert told >= 40 and 0 < sum(x[3] for x in rows) < 120
    df = spark.createDataFrame(rows, "k long, ga array<smallint>, gb array<smallint>, want boolean")
    for many in (1, 3):
        got = similarity.structural(df.repartition(many), ["k"], "ga", "gb", 8, 8, least=0.98, only=True).collect()
        assert {x.k: x.similar for x in got} == {x[0]: x[3] for x in rows}


def test_verified_leaks_are_found_by_bounds(spark):
    """Pairs that bounds decide are not compared: nearly all of the table's."""
    open_pairs = spark.sparkContext.accumulator(0)
    compared = similarity.Blurred.compared

    class Counted(similarity.Blurred):
        def compared(self, *args, **named):
            open_pairs.add(1)
            return compared(self, *args, **named)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(similarity, "Blurred", Counted)
        found = registry.QUERIES["leakage_verified"](spark, SF).first()
        verified = open_pairs.value
        registry.QUERIES["refined_pairs"](spark, SF).collect()  # gives each similarity, so all that pass are compared
    assert found.near_leaks > 100 and verified < found.near_leaks / 10
    assert open_pairs.value - verified > 100


def test_maps_hold_all_that_one_raster_gives():
    r = np.random.default_rng(4)
    blurred, up = similarity.Blurred(8, 8, 256), kernels.lanczos_weights(8, 256)
    blur = lambda x: kernels.gaussian(x, 1.5, 5)
    g = r.integers(0, 256, (8, 8)).astype(float)
    h = np.clip(g + r.integers(-9, 10, g.shape), 0, 255)
    x = up @ g @ up.T
    mean, square, variance = blurred.maps(g)
    assert np.allclose(mean, np.sqrt(2) * blur(x)) and np.allclose(square, blur(x) ** 2 + kernels.C1 / 2)
    assert np.allclose(variance, blur(x * x) - blur(x) ** 2 + kernels.C2 / 2)
    want = kernels.structural_similarity(x, up @ h @ up.T, blur)
    for steps in (1, 2, 5):
        assert np.isclose(blurred.compared(g, h, blurred.maps(g), blurred.maps(h), steps=steps), want, rtol=0, atol=1e-11)
        assert blurred.compared(g, h, blurred.maps(g), blurred.maps(h), want + 1e-6, steps) is None
