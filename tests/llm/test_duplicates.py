"""Exact and near duplicates and components, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import xxhash

from attestor.llm import exact_dedup, simhash
from attestor.llm.components import components
from attestor.llm.exact_dedup import FuseFilter


def test_exact(hard, hard_rows):
    groups = defaultdict(list)
    for d, t, *_ in hard_rows:
        groups[t or ""].append(d)
    want = Counter()
    for d, t, *_ in hard_rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want[d, keep, len(ids), d == keep] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(hard, per_bucket=7).collect())
    assert got == want


def test_exact_empty(empty):
    assert exact_dedup.dedup(empty).count() == 0


def test_fuse_filter():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 500, 20000):
        keys = r.integers(0, 1 << 63, n).astype(np.uint64)
        f = FuseFilter.build(np.concatenate([keys, keys[: n // 2]]))
        assert f.holds(keys).all()
        others = r.integers(0, 1 << 63, 20000).astype(np.uint64)
        assert f.holds(others).mean() < 0.02 or n == 0


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near(hard, hard_rows):
    fps = [brute_fingerprint(t) for _, t, *_ in hard_rows]
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for (d, *_), x in zip(hard_rows, label):
        if d is not None:
            low[x] = min(low.get(x, d), d)
    want = Counter((d, f, low.get(x)) for (d, *_), f, x in zip(hard_rows, fps, label))
    for most in (4096, 1):
        got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(hard, most=most).collect())
        assert got == want


def test_near_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_bit_slices():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 3).astype(np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 3).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 3).astype(np.uint64)) for _ in range(60)]))
    for radius in (0, 1, 2, 3):
        got = {(i, int(j)) for i, js in simhash.within(fps, radius) for j in js}
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert got == want


def test_links_cover_all_classes(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 62, 4)]
    codes = sorted({b ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in r.integers(0, 63, (120, 2))})
    df = spark.createDataFrame([(x,) for x in codes], "fp long")
    for most in (4096, 5):
        found = {(x.node, x.component) for x in components(simhash.links(df, 2, most)).collect()}
        parent = {c: c for c in codes}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                if (a ^ b).bit_count() <= 2:
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
        classes = Counter(root(c) for c in codes)
        assert found == {(c, root(c)) for c in codes if classes[root(c)] > 1}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
