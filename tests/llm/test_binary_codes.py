"""Embedding near-dedup against all pairs in NumPy; the codes' estimates and bounds on their own."""

import numpy as np

from attestor.llm import binary_codes


def plain(rows, least=0.95):
    """{place: (n_links, component's least id)} by comparing all pairs."""
    good = [i for i, (_, x) in enumerate(rows) if x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    n, label = [0] * len(rows), list(range(len(rows)))
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    n[i] += 1
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    ids = [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return [(rows[i][0], n[i], ids[i], rows[i][0] == ids[i]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x, y = binary_codes.unit(r.standard_normal((2, 64)))
    y = binary_codes.unit((x + 0.25 * y)[None])[0]
    found = []
    for seed in range(400):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((64, 64)))
        code, factor = binary_codes.encode((x @ turn)[None])
        signs = (np.unpackbits(code[0]).astype(float) * 2 - 1) / 8
        found.append(float(signs @ (y @ turn) / factor[0]))
        assert binary_codes.may_reach((y @ turn)[None], code, factor, float(x @ y))[0, 0]
    assert abs(np.mean(found) - x @ y) < 0.005 and np.std(found) > 0.005
    far = binary_codes.unit(r.standard_normal((500, 64)))
    assert not binary_codes.may_reach(far, *binary_codes.encode(far[::-1].copy()), 0.95)[np.abs(far @ far[::-1].T) < 0.3].any()


def test_hard_rows(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal(8)
    rows = [(i, (base + r.standard_normal(8) * 0.2).tolist()) for i in range(40)]
    rows += [(100 + i, r.standard_normal(8).tolist()) for i in range(40)]
    rows += [(200, base.tolist()), (201, base.tolist()), (201, base.tolist()), (202, (base * 1e200).tolist()), (203, (base * 1e-200).tolist()), (204, (-base).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None] * 8), (304, [float("nan")] * 8), (305, [float("inf")] + [1.0] * 7), (306, base.tolist()[:7]), (307, base.tolist()[:7])]
    rows += [(None, base.tolist()), (None, [0.0] * 7 + [1e-300]), (None, None), (400, [3.0]), (401, [2.0]), (402, [-1.0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<double>, node string, dim int").repartition(3)
    for most, cell_rows in ((2048, 128), (7, 10)):
        got = [tuple(x) for x in binary_codes.near_duplicates(df, most=most, cell_rows=cell_rows).collect()]
        assert order(got) == order(plain(rows))
    assert binary_codes.near_duplicates(df.limit(0)).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above 0.95, and crowds, in as many components as the table has; several cells."""
    r = np.random.default_rng(2)
    x = binary_codes.unit(r.standard_normal((3000, 64)))
    across = r.standard_normal((1000, 64))
    across -= (across * x[:1000]).sum(axis=1)[:, None] * x[:1000]
    x = np.concatenate([x, 0.951 * x[:1000] + np.sqrt(1 - 0.951**2) * binary_codes.unit(across), x[1000] + 0.02 * r.standard_normal((300, 64))])
    x = np.round(x, 9)
    wide = binary_codes.unit(x)
    near = wide @ wide.T >= 0.95
    n = near.sum(axis=1) - 1
    assert n.sum() > 60_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {q.vec_id: q.n_links for q in binary_codes.near_duplicates(df, cell_rows=64, most=200).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= n).all() and (found == n).mean() > 0.995 and found.sum() > 0.999 * n.sum()
