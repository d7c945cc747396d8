"""Kernels against their definitions, written another way."""

import math

import numpy as np
import pytest

from attestor.functions import channels, regions
from attestor.functions import kernels as k

RNG = np.random.default_rng(206)
IMAGE = RNG.integers(0, 256, (24, 20, 3)).astype(np.uint8)
MASK = RNG.random((15, 13)) > 0.6


def test_reflection():
    a = np.arange(5)[None].repeat(3, 0)
    assert k.shifted(a, 0, -2)[0].tolist() == [2, 1, 0, 1, 2]
    assert k.shifted(a, 0, 2)[0].tolist() == [2, 3, 4, 3, 2]


def test_components_and_holes():
    def flood(mask, eight):
        label, n = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not label[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                        label[a, b] = n
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or not (i and j)]
        return label

    for eight in (True, False):
        a, b = k.label_components(MASK, eight), flood(MASK, eight)
        assert len(set(zip(a.ravel(), b.ravel()))) == a.max() + 1 == b.max() + 1
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert k.fill_holes(ring).sum() == 25
    spiral = np.zeros((31, 31), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    assert k.label_components(spiral).max() == 1
    assert not k.clear_border(ring | (np.indices((7, 7)).sum(0) == 0))[0, 0]


def test_distances():
    d = k.distance_to(MASK)
    points = np.argwhere(MASK)
    want = np.sqrt(((np.argwhere(np.ones_like(MASK))[:, None] - points[None]) ** 2).sum(-1)).min(1).reshape(MASK.shape)
    assert np.allclose(d, want)


def test_boundary_scores():
    empty, one = np.zeros((3, 4), bool), np.zeros((3, 4), bool)
    one[1, 1] = True
    assert k.boundary_scores(empty, empty) == {"boundary_f1": 1.0, "hd95": 0.0, "assd": 0.0}
    assert k.boundary_scores(empty, one) == {"boundary_f1": 0.0, "hd95": 5.0, "assd": 5.0}
    assert k.boundary_scores(one, one)["boundary_f1"] == 1.0
    full = np.ones((5, 6), bool)
    assert k.boundary(full).sum() == 18


def test_dct_and_phash():
    m = k.dct_matrix(16)
    assert np.allclose(m @ m.T, np.eye(16))
    x = RNG.random(16)
    want = [sum(x[n] * math.cos(math.pi * (2 * n + 1) * f / 32) for n in range(16)) * math.sqrt((1 if f == 0 else 2) / 16) for f in range(16)]
    assert np.allclose(m @ x, want)
    assert k.phash(IMAGE) < 2**63 and k.phash(IMAGE, True) % 2**63 == k.phash(IMAGE)


def test_ssim():
    assert k.ssim(IMAGE, IMAGE, 32) == pytest.approx(1)
    flat = lambda v: np.full((12, 12, 3), v, np.uint8)
    assert k.ssim(flat(100), flat(155), 32) < 0.98


@pytest.mark.parametrize("a,b,want", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)])
def test_ciede2000_published_pairs(a, b, want):
    assert k.ciede2000(np.array(a), np.array(b)) == pytest.approx(want, abs=1e-4)


def test_lab_round_trip():
    assert np.abs(k.from_lab(k.to_lab(IMAGE)).astype(int) - IMAGE).max() <= 1


def test_filters():
    padded = np.pad(IMAGE[..., 0].astype(float), 1, mode="reflect")
    want = np.array([[np.median(padded[y : y + 3, x : x + 3]) for x in range(20)] for y in range(24)])
    assert (k.filtered(IMAGE, "median", 2)[..., 0] == want).all()
    assert (k.filtered(IMAGE, "none") == IMAGE).all()
    with pytest.raises(ValueError, match="bilateral"):
        k.filtered(IMAGE, "sharp")
    constant = np.full((9, 9), 0.4)
    for f in (k.guided, k.bilateral, lambda a: k.gaussian(a, 1.0), lambda a: k.box(a, 2), k.wiener, k.deblock):
        assert np.allclose(f(constant), 0.4)


def test_glcm():
    g = RNG.integers(0, 256, (6, 5))
    q = g * 8 // 256
    pairs = [(q[y, x], q[y, x + 1]) for y in range(6) for x in range(4)]
    pairs += [(b, a) for a, b in pairs]
    first = np.mean([(a - b) ** 2 for a, b in pairs])
    only = []
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        p = [(q[y, x], q[y + dy, x + dx]) for y in range(6) for x in range(5) if y + dy < 6 and 0 <= x + dx < 5]
        only.append(np.mean([(a - b) ** 2 for a, b in p]))
    assert only[0] == pytest.approx(first) and k.glcm(g)["contrast"] == pytest.approx(np.mean(only))


def test_noise_and_restoration():
    flat = np.full((64, 64), 100.0)
    noisy = flat + RNG.normal(0, 8, flat.shape)
    assert 6 < k.noise_sigma(noisy) < 10 and k.noise_sigma(flat) == 0
    assert np.abs(k.wiener(noisy) - 100).mean() < np.abs(noisy - 100).mean()
    steps = np.repeat(np.array([0.0, 6.0]), 8)[None].repeat(16, 0)
    assert np.abs(np.diff(k.deblock(steps)[0])).max() < 6


def test_masks_and_paint():
    bright = np.full((10, 10, 3), 90, np.uint8)
    bright[4:6, 4:6] = 255
    hot = k.specular(bright)
    assert hot.sum() == 4 and (regions.filled(bright, hot) == 90).all()
    framed = np.full((20, 20, 3), 150, np.uint8)
    framed[:2] = 0
    framed[10, 10] = 0
    assert k.black_frame(framed).sum() == 40
    hair = np.full((20, 20, 3), 200, np.uint8)
    hair[:, 9] = 60
    assert k.dark_artifacts(hair)[:, 9].all()


def test_names_and_stages():
    for name in k.CORRUPTIONS:
        out = k.corrupt(IMAGE, name, 3)
        assert out.shape == IMAGE.shape and out.dtype == np.uint8
        assert (out == k.corrupt(IMAGE, name, 3)).all()
    for name in channels.CHANNELS:
        assert channels.with_channel(IMAGE, name).shape == (24, 20, 4)
    assert (channels.with_channel(IMAGE, "Hair_Mask") == channels.with_channel(IMAGE, "dark_artifact_mask")).all() and set(channels.ALIASES.values()) <= set(channels.CHANNELS)
    assert (channels.with_channel(IMAGE, "none") == IMAGE).all() and (channels.with_channel(IMAGE, None) == IMAGE).all() and (channels.with_channel(IMAGE, "zeros")[..., 3] == 0).all()
    assert abs(channels.lightness(np.full((2, 2, 3), 255, np.uint8)).astype(int) - 255).max() <= 1 and (channels.with_channel(IMAGE, "v_star")[..., 3] == IMAGE.max(-1)).all()
    with pytest.raises(ValueError):
        k.corrupt(IMAGE, "fog")
    with pytest.raises(ValueError):
        channels.with_channel(IMAGE, "depth")
    every = {s: {} for s in channels.STAGES} | {"extra_channel": {"name": "lbp_texture"}, "gamma": {"value": 1.2}, "retinex": {"sigma": 3.0}, "shading": {"sigma": 3.0}}
    assert channels.preprocess(IMAGE, every).shape == (24, 20, 4)
    assert (channels.preprocess(IMAGE, {"clahe": {"enabled": False}}) == IMAGE).all()
    with pytest.raises(ValueError):
        channels.preprocess(IMAGE, {"sparkle": {}})


def test_contour_and_modulation():
    image = np.full((40, 40, 3), 200, np.uint8)
    image[12:28, 12:28] = (120, 60, 60)
    out, used = k.modulated(image)
    assert used and out[20, 20].sum() < image[20, 20].sum() and (out[2, 2] == image[2, 2]).all()
    assert not k.modulated(np.zeros((20, 20, 3), np.uint8))[1]
    mask, fallback = k.refine(image, k.saliency(image), 0.5)
    assert not fallback and 150 < mask.sum() < 400
    assert k.quality_class(np.zeros((8, 8, 3), np.uint8)) == "low_brightness"


def test_resize():
    a = RNG.random((6, 8))
    assert np.allclose(k.resize(a, 6, 8), a)
    assert np.allclose(k.resize(a, 3, 4, "area"), a.reshape(3, 2, 4, 2).mean((1, 3)))
    assert k.resize(a, 12, 16, "nearest").shape == (12, 16)


def folded(i, n):
    """A place beyond the border, reflected without repeating the border itself."""
    i = abs(i) % (2 * (n - 1))
    return i if i < n else 2 * (n - 1) - i


def test_gabor_by_loops():
    g = k.luminance(IMAGE)
    h, w = g.shape
    best = np.zeros((h, w))
    for angle in (0, 45, 90, 135):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        for y in range(h):
            for x in range(w):
                total = 0.0
                for dy in range(-4, 5):
                    for dx in range(-4, 5):
                        u, v = dx * c + dy * s, -dx * s + dy * c
                        total += math.exp(-(u * u + 0.25 * v * v) / 18) * math.cos(2 * math.pi * u / 6) * g[folded(y + dy, h), folded(x + dx, w)]
                best[y, x] = max(best[y, x], abs(total))
    want = (best - best.min()) / (best.max() - best.min()) * 255
    assert abs(k.gabor(IMAGE) - want).max() <= 0.51


def test_wavelet_energy_by_loops():
    g = k.luminance(IMAGE)
    h, w = g.shape
    taps = [1, 4, 6, 4, 1]
    small = {(y, x): sum(taps[i] * taps[j] * g[folded(y + i - 2, h), folded(x + j - 2, w)] for i in range(5) for j in range(5)) / 256 for y in range(0, h, 2) for x in range(0, w, 2)}
    detail = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            up = sum(taps[i] * taps[j] * small.get((folded(y + i - 2, h), folded(x + j - 2, w)), 0.0) for i in range(5) for j in range(5)) / 64
            detail[y, x] = abs(g[y, x] - up)
    want = (detail - detail.min()) / (detail.max() - detail.min()) * 255
    assert abs(k.wavelet_energy(IMAGE) - want).max() <= 0.51
    assert (k.wavelet_energy(np.full((6, 6, 3), 50, np.uint8)) <= 255).all()


def test_holes_in_dark_lines_are_closed():
    hair = np.full((20, 20, 3), 200, np.uint8)
    hair[:, 8:11] = 60
    hair[7, 9] = 198
    found = k.dark_artifacts(hair)
    assert found[:, 8:11].all() and found.sum() == 60
