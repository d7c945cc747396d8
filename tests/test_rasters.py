"""Rasters from files that the test writes: every kind of PNG, flat caches, and an index with its images."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest

from attestor.sources import rasters


def png(w, h, bits, colour, rows, *more, interlaced=0):
    """A file by hand: rows are bytes with their filter's number first."""
    part = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    head = struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlaced)
    body = zlib.compress(b"".join(map(bytes, rows)))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + b"".join(part(k, x) for k, x in more) + part(b"IDAT", body[:5]) + part(b"IDAT", body[5:]) + part(b"IEND", b"")


def test_filters_by_hand():
    rows = [(0, 10, 20, 30), (1, 10, 10, 10), (2, 1, 1, 1), (3, 5, 5, 5), (4, 250, 1, 2)]
    want = [[10, 20, 30], [10, 20, 30], [11, 21, 31]]
    a = [(5 + 11 // 2) & 255]
    a += [(5 + (a[0] + 21) // 2) & 255]
    a += [(5 + (a[1] + 31) // 2) & 255]
    want.append(a)
    last, left, corner = [], 0, 0
    for add, up in zip((250, 1, 2), a, strict=True):
        guess = left + up - corner
        near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
        left, corner = (add + near) & 255, up
        last.append(left)
    want.append(last)
    assert rasters.decode_png(png(3, 5, 8, 0, rows))[:, :, 0].tolist() == want


def test_kinds_of_png():
    decode = lambda *a, **k: rasters.decode_png(png(*a, **k)).squeeze(-1).tolist()
    assert decode(9, 1, 1, 0, [(0, 0b10110000, 0b10000000)]) == [[255, 0, 255, 255, 0, 0, 0, 0, 255]]
    assert decode(3, 1, 2, 0, [(0, 0b00011100)]) == [[0, 85, 255]]
    assert decode(3, 1, 4, 0, [(0, 0x0F, 0x80)]) == [[0, 255, 136]]
    assert decode(2, 1, 16, 0, [(0, 1, 200, 255, 0)]) == [[1, 255]]
    palette = (b"PLTE", bytes([1, 2, 3, 9, 8, 7]))
    assert rasters.decode_png(png(3, 1, 1, 3, [(0, 0b01000000)], palette)).tolist() == [[[1, 2, 3], [9, 8, 7], [1, 2, 3]]]
    r = np.random.default_rng(0)
    for samples in (1, 2, 3, 4):
        image = r.integers(0, 256, (13, 7, samples), np.uint8)
        for filters in (None, 0, 1, 2, 3, 4):
            for bits in (8, 16):
                assert (rasters.decode_png(rasters.encode_png(image, filters, bits)) == image).all()
    whole = rasters.encode_png(image)
    wrong = [b"", b"GIF89a", whole[:-1], whole[:40], whole[:50] + b"\x00" + whole[51:], png(3, 1, 1, 3, [(0, 0b01000000)]), png(2, 1, 8, 0, [(0, 1, 2)], interlaced=1), png(2, 1, 8, 0, [(7, 1, 2)]), png(2, 2, 8, 0, [(0, 1, 2)]), png(2, 1, 3, 0, [(0, 1)]), png(0, 1, 8, 0, [(0,)])]
    for x in wrong:
        with pytest.raises(ValueError):
            rasters.decode_png(x)


def test_files(spark, tmp_path):
    r = np.random.default_rng(1)
    colours, grey = r.integers(0, 256, (12, 10, 4), np.uint8), r.integers(0, 256, (6, 8, 1), np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(rasters.encode_png(colours))
    (tmp_path / "sub/b.PNG").write_bytes(rasters.encode_png(grey))
    (tmp_path / "bad.png").write_bytes(rasters.encode_png(grey)[:60])
    (tmp_path / "note.txt").write_text("no image")
    read = lambda **k: {x.path.rsplit("/", 1)[1]: x for x in rasters.images(spark, str(tmp_path), **k).collect()}
    rgb = read()
    assert set(rgb) == {"a.png", "b.PNG", "bad.png"} and rgb["bad.png"].error and rgb["bad.png"].pixels is None
    assert (rgb["a.png"].height, rgb["a.png"].width, rgb["a.png"].channels) == (12, 10, 3) and bytes(rgb["a.png"].pixels) == colours[:, :, :3].tobytes()
    assert bytes(rgb["b.PNG"].pixels) == np.repeat(grey, 3, axis=2).tobytes()
    light = np.rint(colours[:, :, :3].astype(float) @ [0.299, 0.587, 0.114])
    assert bytes(read(form="grey")["a.png"].pixels) == light.astype(np.uint8).tobytes()
    assert bytes(read(form="mask")["b.PNG"].pixels) == (grey > 127).astype(np.uint8).tobytes()
    half = read(form="mask", resize=(3, 4))["b.PNG"]
    assert (half.height, half.width) == (3, 4) and bytes(half.pixels) == (grey[::2, ::2, 0] > 127).astype(np.uint8).tobytes()
    mean = np.rint(grey[:, :, 0].reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert abs(np.frombuffer(read(form="grey", resize=(3, 4))["b.PNG"].pixels, np.uint8).reshape(3, 4) - mean).max() <= 1
    got = {x.path.rsplit("/", 1)[1]: (x.height, x.width) for x in rasters.sizes(rasters.files(spark, str(tmp_path)), "path").collect()}
    assert got == {"a.png": (12, 10), "b.PNG": (6, 8), "bad.png": (6, 8)}
    odd = spark.createDataFrame([(1, None), (2, b"")], "k long, content binary")
    assert [(x.k, x.error is not None) for x in rasters.decoded(odd, "k").orderBy("k").collect()] == [(1, True), (2, True)]
    assert rasters.decoded(odd.limit(0), "k").collect() == []


def directory_of(spark, cache):
    rows = [(i, f"g{i // 2}", "clean" if i % 2 else "blur", hashlib.sha256(x.tobytes()).hexdigest()) for i, x in enumerate(cache)]
    return rows, "index long, group_key string, corruption string, digest string"


def test_caches(spark, tmp_path):
    cache = np.random.default_rng(2).integers(0, 256, (5000, 8, 8), np.uint8)
    (tmp_path / "c.bin").write_bytes(cache.tobytes())
    (tmp_path / "zero.bin").write_bytes(bytes(cache.size))
    rows, schema = directory_of(spark, cache)
    good = spark.createDataFrame(rows, schema)
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", "65536")
    try:
        assert rasters.records(spark, str(tmp_path / "c.bin"), 64).rdd.getNumPartitions() >= 5  # parts of the file, not the whole
        wanted = good.where("index % 1000 = 7").select("index", "group_key")
        got = rasters.packed(spark, str(tmp_path / "c.bin"), wanted, 8, 8).collect()
        assert {x["index"]: bytes(x.raster) for x in got} == {i: cache[i].tobytes() for i in (7, 1007, 2007, 3007, 4007)}
        assert rasters.cache_findings(spark, str(tmp_path / "c.bin"), good, 8, 8).collect() == []
        blank = good.drop("digest").selectExpr("*", f"'{hashlib.sha256(bytes(64)).hexdigest()}' digest")
        assert rasters.cache_findings(spark, str(tmp_path / "zero.bin"), blank, 8, 8, blank=True).collect() == []
        bad = rows[:4990] + [(7, "other", "clean", rows[7][3]), (6000, "far", "clean", rows[0][3]), (4990, "g2495", "blur", "0" * 64), (4991, " ", "clean", rows[4991][3]), (4992, "g0", "blur", rows[4992][3])]
        found = {(x["index"], x.finding) for x in rasters.cache_findings(spark, str(tmp_path / "c.bin"), spark.createDataFrame(bad, schema), 8, 8).collect()}
        assert found == {(i, "not listed") for i in range(4993, 5000)} | {(7, "repeated index"), (6000, "no record"), (4990, "digest"), (4991, "no group"), (0, "repeated key")}
        assert rasters.cache_findings(spark, str(tmp_path / "c.bin"), good, 8, 8, blank=True).where("finding = 'not blank'").count() == 5000
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")
    other = spark.createDataFrame([(0, "gX", "blur", "d"), *rows[1:4999]], schema)
    assert {(x["index"], x.finding) for x in rasters.cache_pair_findings(good, other).collect()} == {(0, "not in control"), (0, "not in candidate"), (4999, "not in control")}
    (tmp_path / "cut.bin").write_bytes(bytes(100))
    with pytest.raises(Exception, match="(?i)record|partial|length|eof"):
        rasters.records(spark, str(tmp_path / "cut.bin"), 64).collect()


def test_dataset_index(spark, tmp_path):
    r = np.random.default_rng(3)
    root = tmp_path / "data"
    root.mkdir()
    rows = []
    for i in range(10):
        image, mask = r.integers(0, 256, (9, 6, 3), np.uint8), r.integers(0, 256, (9, 6, 1), np.uint8)
        (root / f"i{i}.png").write_bytes(rasters.encode_png(image))
        (root / f"m{i}.png").write_bytes(rasters.encode_png(mask))
        fold = i // 2
        rgb, binary = hashlib.sha256(b"9x6x3|" + image.tobytes()).hexdigest(), hashlib.sha256(b"9x6|" + (mask > 127).astype(np.uint8).tobytes()).hexdigest()
        rows.append({"sample_id": f"s{i}", "group_key": f"g{i}", "role": "holdout" if fold == 4 else "fit", "split": "train_screen_holdout" if fold == 4 else "train", "source_split": "train", "fold": fold, "image_relative": f"i{i}.png", "mask_relative": f"m{i}.png", "rgb_sha256": rgb, "mask_sha256": binary})
    whole = {"schema_version": "index.v1", "row_count": 10, "fit_count": 8, "holdout_count": 2, "rows": rows}
    folds = dict.fromkeys(range(5), 2)

    def load(index, sha=None):
        text = json.dumps(index, indent=1).encode()
        (tmp_path / "index.json").write_bytes(text)
        return rasters.dataset_index(spark, str(tmp_path / "index.json"), sha or hashlib.sha256(text).hexdigest(), "index.v1", folds)

    loaded = load(whole)
    pairs = rasters.indexed_pairs(spark, loaded, str(root), side=3).collect()
    assert len(pairs) == 10 and all(p.finding is None and len(p.image) == 27 and len(p.mask) == 9 and set(bytes(p.mask)) <= {0, 1} for p in pairs)
    (root / "i3.png").write_bytes((root / "i4.png").read_bytes())
    (root / "m5.png").unlink()
    (root / "i6.png").write_bytes(b"x")
    found = {p.sample_id: p.finding for p in rasters.indexed_pairs(spark, loaded, str(root), side=3).collect()}
    assert {k: v for k, v in found.items() if v} == {"s3": "image digest", "s5": "mask: no content", "s6": "image: not a PNG"}
    changed = lambda i, **k: whole | {"rows": [x | k if n == i else x for n, x in enumerate(rows)]}
    for index, fault in (
        (changed(0, fold=4), "role and fold"), (changed(0, role="holdout"), "role and fold"), (changed(9, split="train"), "role and fold"), (changed(1, source_split="test"), "source split"),
        (changed(1, group_key=" "), "group"), (changed(1, group_key="g2"), "repeated group"), (changed(2, mask_relative="../m.png"), "path"), (changed(2, image_relative="/i.png"), "path"),
        (changed(2, rgb_sha256="x"), "digest"), (whole | {"row_count": 9}, "counts"), (whole | {"rows": rows[:9]}, "counts"), (whole | {"schema_version": "index.v2"}, "schema version"),
    ):
        with pytest.raises(ValueError, match=fault):
            load(index)
    with pytest.raises(ValueError, match="file digest"):
        load(whole, "0" * 64)
