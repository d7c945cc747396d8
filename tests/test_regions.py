"""Superpixels, their descriptions, mean shift and filling, against loop versions and known images."""

import math

import numpy as np

from attestor.functions import kernels, regions


def quarters(side=24):
    image = np.zeros((side, side, 3), np.uint8)
    half = side // 2
    for k, colour in enumerate(((200, 30, 30), (30, 200, 30), (30, 30, 200), (220, 220, 40))):
        image[k // 2 * half : (k // 2 + 1) * half, k % 2 * half : (k % 2 + 1) * half] = colour
    return image


def test_superpixels_follow_colours_and_are_connected():
    image = quarters()
    label = regions.superpixels(image, 4)
    assert label.max() == 3 and all(len(np.unique(label[a : a + 12, b : b + 12])) == 1 for a in (0, 12) for b in (0, 12))
    r = np.random.default_rng(0)
    noisy = np.clip(quarters(32).astype(int) + r.integers(-40, 40, (32, 32, 3)), 0, 255).astype(np.uint8)
    for many in (1, 9, 30):
        label = regions.superpixels(noisy, many, compactness=10)
        ids, n = np.unique(label, return_counts=True)
        assert ids.tolist() == list(range(len(ids))) and len(ids) <= 4 * many
        assert len(ids) == 1 or n.min() >= 32 * 32 / many / 4
        assert all(kernels.label_components(label == k, eight=False).max() == 1 for k in ids)
    assert (regions.superpixels(image[:1, :1], 5) == 0).all()


def test_one_step_of_superpixels_by_loops():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (12, 12, 3), np.uint8)
    lab, step = kernels.to_lab(image), math.sqrt(144 / 9)
    at = [1.5, 5.5, 9.5]
    centres = [(*lab[round(y), round(x)], y, x) for y in at for x in at]
    want = np.zeros((12, 12), int)
    for y in range(12):
        for x in range(12):
            d = [sum((lab[y, x][i] - c[i]) ** 2 for i in range(3)) + (10 / step) ** 2 * ((y - c[3]) ** 2 + (x - c[4]) ** 2) if abs(y - int(c[3])) <= 8 and abs(x - int(c[4])) <= 8 else math.inf for c in centres]
            want[y, x] = int(np.argmin(d))
    import unittest.mock

    with unittest.mock.patch.object(regions, "_connected", lambda label, least: label):
        assert (regions.superpixels(image, 9, steps=1) == want).all()


def test_descriptions_by_loops():
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (14, 18, 3), np.uint8)
    label = regions.superpixels(image, 6)
    got = regions.described(image, label)
    lab = (kernels.to_lab(image) + (0, 128, 128)) / (100, 255, 255)
    rim = np.zeros((14, 18), bool)
    rim[[0, -1]], rim[:, [0, -1]] = True, True
    band = np.ones((14, 18), bool)
    band[1:-1, 1:-1] = False
    area = [(label == k).mean() for k in range(label.max() + 1)]
    centre = [((np.nonzero(label == k)[0].mean() + 0.5) / 14, (np.nonzero(label == k)[1].mean() + 0.5) / 18) for k in range(label.max() + 1)]
    means = [lab[label == k].mean(0) for k in range(label.max() + 1)]
    column = {n: i for i, n in enumerate(regions.NAMES)}
    for k in range(label.max() + 1):
        m = label == k
        row = {n: got[k, i] for n, i in column.items()}
        assert np.isclose([row[f"lab_{i}_mean"] for i in range(3)], means[k]).all() and np.isclose([row[f"rgb_{i}_std"] for i in range(3)], (image[m] / 255).std(0)).all()
        assert np.isclose((row["area"], row["centre_y"], row["centre_x"]), (area[k], *centre[k])).all()
        assert math.isclose(row["on_border"], (m & rim).sum() / math.sqrt(m.sum())) and math.isclose(row["from_border"], 2 * min(*centre[k], 1 - centre[k][0], 1 - centre[k][1]))
        weights = [0 if j == k else area[j] * math.exp(-math.dist(centre[j], centre[k]) ** 2 / (2 * 0.4**2)) for j in range(len(area))]
        contrast = sum(x * math.dist(means[j], means[k]) / math.sqrt(3) for j, x in enumerate(weights)) / sum(weights)
        away = math.dist(means[k], lab[band].mean(0)) / math.sqrt(3)
        assert np.isclose((row["contrast"], row["from_background"], row["like_background"]), (contrast, away, math.exp(-(away**2) / 0.08))).all()
    assert np.isfinite(got).all() and regions.to_hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8))[0, :, 0].tolist() == [0, 1 / 3, 2 / 3, 0]


def test_mean_shift_by_loops():
    r = np.random.default_rng(3)
    image = np.clip(quarters(10).astype(int) + r.integers(-8, 8, (10, 10, 3)), 0, 255).astype(np.uint8)
    want = np.zeros((10, 10, 3))
    for y in range(10):
        for x in range(10):
            p, c = (float(y), float(x)), image[y, x].astype(float)
            for _ in range(5):
                v, u = round(p[0]), round(p[1])
                near = [(image[b, a].astype(float), b, a) for b in range(max(0, v - 2), min(10, v + 3)) for a in range(max(0, u - 2), min(10, u + 3)) if math.dist(image[b, a], c) <= 25]
                q, d = (np.mean([b for _, b, _ in near]), np.mean([a for *_, a in near])), np.mean([t for t, *_ in near], axis=0)
                moved = abs(q[0] - p[0]) + abs(q[1] - p[1]) + abs(d - c).sum()
                p, c = q, d
                if moved < 0.1:
                    break
            want[y, x] = np.rint(c)
    assert abs(regions.mean_shift(image, 2, 25.0).astype(int) - want).max() <= 1
    edges = regions.boundary_proxy(quarters())
    assert edges.max() == 255 and edges[11, 3] > 0 and edges[3:9, 3:9].max() == 0 and (regions.boundary_proxy(np.full((6, 6, 3), 9, np.uint8)) == 0).all()


def test_front_and_filling():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    order, times = regions.march(mask)
    assert len(order) == 25 and order[-1] == (4, 4) and all(times[a] <= times[b] for a, b in zip(order, order[1:], strict=False))
    assert 0.95 < times[2, 4] <= 1 and times[3, 4] > 1.5 and math.isclose(times[2, 2], math.sqrt(0.5)) and (times[~mask] == 0).all()
    flat = np.full((9, 9, 3), 77, np.uint8)
    hole = flat.copy()
    hole[mask] = 0
    assert (regions.filled(hole, mask, most=None) == 77).all() and (regions.filled(hole, mask, most=0.1) == hole).all()
    ramp = np.repeat(np.arange(0, 90, 10, dtype=np.uint8)[None, :, None], 9, axis=0).repeat(3, axis=2)
    hole = ramp.copy()
    hole[mask] = 255
    assert abs(regions.filled(hole, mask, most=None).astype(int) - ramp).max() <= 6  # a slope is carried on
    assert (regions.filled(hole, np.zeros((9, 9), bool)) == hole).all() and (regions.filled(hole, np.ones((9, 9), bool), most=None) == hole).all()
