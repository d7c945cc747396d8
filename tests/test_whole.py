"""Registered queries that must do the whole job, against what NumPy, hashlib and plain Python make of the tables."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq

from attestor.plans import registry

from .compare import SF


def column(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(t[x] for x in columns), strict=True))


def test_phrases_of_whole_pages(spark):
    pages = column("pages", "page_id", "html")
    assert any(len(html) > 400 for _, html in pages)
    want = {i: re.sub(r"[ \t\n\r\f\v]+", " ", html.lower()).strip(" ") for i, html in pages}
    assert {r.page_id: r.phrase for r in registry.QUERIES["phrases"](spark, SF).collect()} == want


def test_forest_as_in_production(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    fitted, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data: fitted.append((self.getNumTrees(), self.getMaxDepth(), data.count())) or fit(self, data))
    found = {r.fold: r.n for r in registry.QUERIES["region_forest"](spark, SF).collect()}
    total = 4 * len(column("embeddings", "vec_id"))
    assert set(found) == set(range(5)) and sum(found.values()) == total
    assert fitted == [(96, 12, total - found[i]) for i in range(5)]


def levels(v):
    return [int(x) for x in np.clip(np.floor((np.float64(np.float32(v)) + 1) * 127.5), 0, 255)]


def plain_code(g):
    """63 bits by the definitions: windowed sinc of three lobes to 32 x 32, cosine transform, low frequencies over their median."""
    weight = np.zeros((32, 8))
    for j in range(32):
        for y in range(8):
            d = y + 0.5 - (j + 0.5) / 4
            weight[j, y] = 1.0 if d == 0 else np.sin(np.pi * d) / (np.pi * d) * np.sin(np.pi * d / 3) / (np.pi * d / 3) if abs(d) < 3 else 0.0
        weight[j] /= weight[j].sum()
    large = weight @ np.array(g, float).reshape(8, 8) @ weight.T
    low = []
    for u in range(8):
        for v in range(8):
            wave = np.outer(*(np.cos(np.pi * (2 * np.arange(32) + 1) * f / 64) * (0.25 if f else 0.25 / np.sqrt(2)) for f in (u, v)))
            low.append((large * wave).sum())
    bits = np.array(low[1:]) > np.median(low[1:])
    return int("".join("1" if x else "0" for x in bits), 2), large


def plain_ssim(g, h):
    """By windows of 11 x 11 cut out one by one, at a few places of the 256 x 256 rasters, as their mean over all places is slow to get."""
    from attestor.functions import kernels

    x, y = (kernels.resize(np.array(v, float).reshape(8, 8), 256, 256, "lanczos") for v in (g, h))
    t = np.exp(-0.5 * (np.arange(-5, 6) / 1.5) ** 2)
    w = np.outer(t, t) / t.sum() ** 2
    total = 0.0
    for i in range(5, 251, 15):
        for j in range(5, 251, 15):
            a, b = (z[i - 5 : i + 6, j - 5 : j + 6] for z in (x, y))
            ma, mb = (a * w).sum(), (b * w).sum()
            va, vb, cov = (a * a * w).sum() - ma**2, (b * b * w).sum() - mb**2, (a * b * w).sum() - ma * mb
            total += (2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma**2 + mb**2 + 6.5025) * (va + vb + 58.5225))
    return total / 17**2


def test_near_duplicate_audit(spark):
    """Codes, near pairs and their refinement over a whole small scale, from records made here a second time."""
    made = {}
    for i, v in column("embeddings", "vec_id", "embedding"):
        g = levels(v)
        noisy = g if i % 10 == 0 else [min(255, max(0, x + ((k + 1) ** 2 + i) % 3 - 1)) for k, x in enumerate(g)]
        for k, x in enumerate((g, [min(255, x + 40) for x in g], [(x + 128) // 2 for x in g], noisy)):
            made[4 * i + k] = x
    code = {n: plain_code(g)[0] for n, g in made.items()}
    assert {r.n: r.code for r in registry.QUERIES["phash63"](spark, SF).collect()} == code
    n = np.array(sorted(made))
    x = np.array([code[i] for i in n.tolist()])
    near = {}
    for at, i in enumerate(n.tolist()):
        d = np.bitwise_count(x[at + 1 :] ^ x[at])
        near.update({(i, int(n[at + 1 + j])): int(d[j]) for j in np.flatnonzero(d <= 4)})
    pairs = {p: d for p, d in near.items() if made[p[0]] != made[p[1]]}
    assert len(near) > len(pairs) and set(pairs.values()) == {0, 2, 4}  # 31 bits of each code are set
    got = registry.QUERIES["near_dup_banded"](spark, SF).collect()
    assert len(got) == len(pairs) and {(r.a, r.b): r.distance for r in got} == pairs
    train = {i: int(hashlib.sha256(f"1729::{i}".encode()).hexdigest()[:16], 16) / 2.0**64 < 0.7 for i in made}
    across = {p for p in pairs if train[p[0]] != train[p[1]]}
    refined = {(r.a, r.b): r.ssim for r in registry.QUERIES["refined_pairs"](spark, SF).collect()}
    assert set(refined) < across and len(refined) > 100
    for p in sorted(across)[:40]:
        want = plain_ssim(made[p[0]], made[p[1]])
        assert abs(refined[p] - want) < 0.01 if p in refined else want < 0.985
    r = registry.QUERIES["leakage_verified"](spark, SF).first()
    assert (r.near_candidates, r.near_leaks) == (len(across), len(refined))


def test_null_rasters_and_contents(spark):
    """A null or cut raster has no code and no pair; two null contents are taken as equal."""
    from attestor.operators import similarity

    flat = [*range(64)]
    rows = [(1, flat, "x"), (2, flat, "y"), (3, flat, None), (4, flat, None), (5, flat[:63], "z"), (6, None, "z"), (7, [None, *flat[1:]], "z"), (8, flat[::-1], "w")]
    df = spark.createDataFrame(rows, "n long, g array<int>, rgb string")
    codes = similarity.frequency_codes(df, "n", "g", 8, 8)
    assert {r.n for r in codes.where("code is null").collect()} == {5, 6, 7}
    got = {(r.a, r.b) for r in similarity.near_pairs(df.join(codes, "n"), "n", "code", 63, 4, apart="rgb").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)}
    assert similarity.near_pairs(df.join(codes, "n").limit(0), "n", "code", 63, 4).collect() == []


def test_every_price_is_checked(spark):
    known = {round(abs(v), 4) for (v,) in column("customer", "c_acctbal")}
    tokens = {round(p, 2) for (p,) in column("part", "p_retailprice")}
    got = registry.QUERIES["number_support"](spark, SF).collect()
    assert len(got) == len(tokens) and {r.token: r.supported for r in got} == {t: round(abs(t), 4) in known for t in tokens}


def test_bootstraps_draw_2000_resamples(spark):
    arms = {}
    for user, kind, value in column("events", "user_id", "event_type", "value"):
        arms.setdefault(user, {}).setdefault(kind, []).append(value)
    mean = {u: {k: float(np.mean(x)) for k, x in a.items()} for u, a in sorted(arms.items())}
    paired = [m["click"] - m["view"] for m in mean.values() if "click" in m and "view" in m]
    cluster = [float(np.mean(list(m.values()))) for m in mean.values()]
    for name, seed, v in (("paired_bootstrap_hash", 204, np.array(paired)), ("cluster_bootstrap_hash", 206, np.array(cluster))):
        n = len(v)
        drawn = np.array([[int(hashlib.md5(f"{seed}:{i}:{d}".encode()).hexdigest()[:8], 16) % n for d in range(n)] for i in range(2000)])
        low, high = np.quantile(np.median(v[drawn], axis=1), [0.025, 0.975])
        r = registry.QUERIES[name](spark, SF).first()
        assert (r.n, r.iterations) == (n, 2000)
        np.testing.assert_allclose((r.estimate, r.lower, r.upper), (np.median(v), low, high), atol=2e-6)
