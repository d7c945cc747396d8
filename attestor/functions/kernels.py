"""Raster kernels on NumPy arrays: uint8 images H x W x 3, masks and maps H x W.

Written from definitions; borders reflect without repeating the edge pixel unless said otherwise.
"""

from __future__ import annotations

import math

import numpy as np

# plumbing


def as_unit(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image)
    return image.astype(np.float64) / 255 if image.dtype == np.uint8 else np.clip(image.astype(np.float64), 0, 1)


def as_bytes(unit: np.ndarray) -> np.ndarray:
    """Back to bytes, halves to even."""
    return np.rint(np.clip(unit, 0, 1) * 255).astype(np.uint8)


def luminance(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image, np.float64)
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def shifted(a: np.ndarray, dy: int, dx: int, fill: float | None = None) -> np.ndarray:
    """a moved so that out[y, x] = a[y + dy, x + dx]; beyond the border reflected, or `fill`."""
    h, w = a.shape[:2]
    y, x = np.arange(h) + dy, np.arange(w) + dx
    if fill is None:
        fold = lambda i, n: np.zeros_like(i) if n == 1 else (lambda m: np.where(m < n, m, 2 * (n - 1) - m))(np.mod(i, 2 * (n - 1)))
        return a[fold(y, h)][:, fold(x, w)]
    out = np.full_like(a, fill)
    ys, xs = (y >= 0) & (y < h), (x >= 0) & (x < w)
    out[np.ix_(ys, xs)] = a[np.ix_(y[ys], x[xs])]
    return out


def correlate_rows(a: np.ndarray, taps: np.ndarray) -> np.ndarray:
    r = len(taps) // 2
    return sum(t * shifted(a, 0, i - r) for i, t in enumerate(taps))


def separable(a: np.ndarray, taps: np.ndarray) -> np.ndarray:
    a = correlate_rows(np.asarray(a, np.float64), taps)
    return np.swapaxes(correlate_rows(np.swapaxes(a, 0, 1), taps), 0, 1)


def gaussian_taps(sigma: float, radius: int | None = None) -> np.ndarray:
    r = radius if radius is not None else max(1, math.ceil(3 * sigma))
    t = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return t / t.sum()


def gaussian(a: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    return separable(a, gaussian_taps(sigma, radius))


def box(a: np.ndarray, radius: int) -> np.ndarray:
    return separable(a, np.full(2 * radius + 1, 1 / (2 * radius + 1)))


def neighbourhood(a: np.ndarray, radius: int, fill: float | None = None) -> np.ndarray:
    return np.stack([shifted(a, dy, dx, fill) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])


def median_filter(a: np.ndarray, size: int) -> np.ndarray:
    """Even sizes become the next odd one."""
    size |= 1
    return np.median(neighbourhood(a, size // 2), axis=0).astype(np.asarray(a).dtype)


def dilate(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return neighbourhood(mask.astype(bool), radius, False).any(axis=0)


def erode(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """Outside counts as background."""
    return neighbourhood(mask.astype(bool), radius, False).all(axis=0)


def label_components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels from 1, 0 outside: least index spreads until nothing changes."""
    mask = mask.astype(bool)
    big = mask.size + 1
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), big)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (eight or not (dy and dx))]
    while True:
        new = np.where(mask, np.min([shifted(label, dy, dx, big) for dy, dx in steps], axis=0), big)
        new = np.where(mask, np.append(new.ravel(), [big, big])[np.where(mask, new - 1, 0)].reshape(mask.shape), big)  # jump to the label's own label
        if (new == label).all():
            break
        label = new
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.unique(label[mask], return_inverse=True)[1] + 1
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = label_components(~mask.astype(bool), eight=False)
    edge = np.unique(np.concatenate([outside[0], outside[-1], outside[:, 0], outside[:, -1]]))
    return mask.astype(bool) | ((outside > 0) & ~np.isin(outside, edge))


def clear_border(mask: np.ndarray) -> np.ndarray:
    label = label_components(mask)
    edge = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
    return mask.astype(bool) & ~np.isin(label, edge[edge > 0])


def hysteresis(score: np.ndarray, low: float, high: float) -> np.ndarray:
    """Components over `low` that reach `high` somewhere."""
    label = label_components(score >= low)
    keep = np.unique(label[(score >= high) & (label > 0)])
    return np.isin(label, keep)


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest true pixel; infinity if there is none."""
    h, w = mask.shape
    ys = np.arange(h)[:, None]
    column = np.full((h, w), np.inf)
    for x in range(w):
        rows = np.flatnonzero(mask[:, x])
        if len(rows):
            column[:, x] = np.abs(ys - rows[None, :]).min(axis=1) ** 2
    xs = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.sqrt((column[:, None, :] + xs[None]).min(axis=2))


def lanczos_weights(n: int, m: int) -> np.ndarray:
    """The matrix that resizes n values to m by a windowed sinc of three lobes, widened where values get fewer."""
    scale = n / m
    at = (np.arange(n)[None] + 0.5 - (np.arange(m)[:, None] + 0.5) * scale) / max(1.0, scale)
    w = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int, mode: str = "bilinear") -> np.ndarray:
    h, w = a.shape[:2]
    if mode == "lanczos":
        return np.moveaxis(np.tensordot(np.tensordot(lanczos_weights(h, height), np.asarray(a, np.float64), (1, 0)), lanczos_weights(w, width), (1, 1)), -1, 1)
    if mode == "nearest":
        return a[np.minimum((np.arange(height) * h) // height, h - 1)][:, np.minimum((np.arange(width) * w) // width, w - 1)]
    if mode == "area":
        weights = lambda n, m: np.clip(np.minimum((np.arange(m)[:, None] + 1) * n / m, np.arange(n) + 1) - np.maximum(np.arange(m)[:, None] * n / m, np.arange(n)), 0, None) * m / n
        return np.tensordot(weights(h, height), np.tensordot(np.asarray(a, np.float64), weights(w, width), (1, 1)).swapaxes(-1, 1) if a.ndim == 3 else np.asarray(a, np.float64) @ weights(w, width).T, (1, 0))
    at = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    y, x = at(h, height), at(w, width)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, 1, *[1] * (a.ndim - 2)), (x - x0).reshape(1, -1, *[1] * (a.ndim - 2))
    a = np.asarray(a, np.float64)
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


# quality


def luminance_stats(image: np.ndarray) -> tuple[float, float]:
    g = luminance(image)
    return float(g.mean()), float(g.std())


def entropy(image: np.ndarray) -> float:
    p = np.bincount(np.clip(np.rint(luminance(image)), 0, 255).astype(int).ravel(), minlength=256) / luminance(image).size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def laplacian(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, np.float64)
    return sum(shifted(a, dy, dx) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))) - 4 * a


def laplacian_variance(image: np.ndarray) -> float:
    return float(laplacian(luminance(image)).var())


def blockiness(image: np.ndarray, block: int = 8) -> float:
    """Mean jump over block borders less the mean jump elsewhere, of luminance in [0, 1], at least 0."""
    g = luminance(image) / 255
    out = []
    for d in (np.abs(np.diff(g, axis=1)), np.abs(np.diff(g, axis=0)).T):
        border = (np.arange(1, d.shape[1] + 1) % block) == 0
        out.append((d[:, border].mean() if border.any() else 0.0) - (d[:, ~border].mean() if (~border).any() else 0.0))
    return float(max(0.0, np.mean(out)))


def glcm(gray: np.ndarray, levels: int = 8) -> dict[str, float]:
    """Texture of co-occurring levels over four offsets, symmetric, averaged."""
    q = np.minimum((np.asarray(gray, np.float64) * levels / 256).astype(int), levels - 1)
    h, w = q.shape
    i, j = np.meshgrid(np.arange(levels), np.arange(levels), indexing="ij")
    rows = []
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        a = q[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = q[dy:, max(0, dx) : w + min(0, dx)]
        m = np.zeros((levels, levels))
        np.add.at(m, (a.ravel(), b.ravel()), 1)
        p = (m + m.T) / max(1.0, 2 * m.sum())
        mean = (i * p).sum()
        var = ((i - mean) ** 2 * p).sum()
        cov = ((i - mean) * (j - mean) * p).sum()
        rows.append((((i - j) ** 2 * p).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p**2).sum()), cov / var if var > 1e-12 else 1.0))
    return dict(zip(("contrast", "homogeneity", "energy", "correlation"), map(float, np.mean(rows, axis=0)), strict=True))


def quality_class(image: np.ndarray, bright: float = 122.0, blocky: float = 0.02, contrast: float = 13.0) -> str:
    mean, std = luminance_stats(image)
    return "low_brightness" if mean < bright else "jpeg" if blockiness(image) >= blocky else "low_contrast" if std < contrast else "clean"


# colour


def gray_world(image: np.ndarray) -> np.ndarray:
    f = as_unit(image)
    means = f.reshape(-1, 3).mean(0)
    return as_bytes(f * (means.mean() / np.maximum(means, 1e-6)))


def shades_of_gray(image: np.ndarray, norm: float = 6.0, low: float = 0.85, high: float = 1.15) -> np.ndarray:
    f = as_unit(image)
    light = (f.reshape(-1, 3) ** norm).mean(0) ** (1 / norm)
    return as_bytes(f * np.clip(light.mean() / np.maximum(light, 1e-6), low, high))


def gamma(image: np.ndarray, g: float) -> np.ndarray:
    table = np.rint((np.arange(256) / 255) ** (1 / g) * 255).astype(np.uint8)
    return table[np.asarray(image, np.uint8)]


def stretch(values: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    a, b = np.percentile(values, [low, high])
    return np.zeros(values.shape, np.uint8) if b - a < 1e-12 else as_bytes((values - a) / (b - a))


def retinex(image: np.ndarray, sigma: float = 30.0) -> np.ndarray:
    f = np.asarray(image, np.float64) + 1
    out = np.log(f) - np.log(np.stack([gaussian(f[..., c], sigma) for c in range(3)], -1))
    return np.stack([stretch(out[..., c]) for c in range(3)], -1)


def invariant_gray(image: np.ndarray) -> np.ndarray:
    f = as_unit(image) + 1e-3
    return stretch(np.log(f[..., 0]) - 0.5 * (np.log(f[..., 1]) + np.log(f[..., 2])))


def shade_attenuated(image: np.ndarray, sigma: float = 25.0) -> np.ndarray:
    g = luminance(image)
    return stretch(g - gaussian(g, sigma))


def red_chromaticity(image: np.ndarray) -> np.ndarray:
    f = np.asarray(image, np.float64)
    return as_bytes(f[..., 0] / np.maximum(f.sum(-1), 1e-6))


def density_component(image: np.ndarray) -> np.ndarray:
    """First principal component of optical density; its sign is made such that the first channel weighs positive."""
    od = -np.log((np.asarray(image, np.float64) + 1) / 256).reshape(-1, 3)
    od -= od.mean(0)
    axis = np.linalg.svd(od, full_matrices=False)[2][0]
    return stretch((od @ (axis if axis[0] >= 0 else -axis)).reshape(image.shape[:2]))


def to_lab(image: np.ndarray) -> np.ndarray:
    f = as_unit(image)
    f = np.where(f <= 0.04045, f / 12.92, ((f + 0.055) / 1.055) ** 2.4)
    xyz = f @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    t = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * t[..., 1] - 16, 500 * (t[..., 0] - t[..., 1]), 200 * (t[..., 1] - t[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    t = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    xyz = np.where(t > 0.206893, t**3, (t - 16 / 116) / 7.787) * np.array([0.950456, 1.0, 1.088754])
    f = xyz @ np.array([[3.240479, -1.537150, -0.498535], [-0.969256, 1.875992, 0.041556], [0.055648, -0.204043, 1.057311]]).T
    f = np.clip(f, 0, 1)
    return as_bytes(np.where(f <= 0.0031308, 12.92 * f, 1.055 * f ** (1 / 2.4) - 0.055))


def on_lightness(image: np.ndarray, f) -> np.ndarray:
    lab = to_lab(image)
    lab[..., 0] = np.asarray(f(as_bytes(lab[..., 0] / 100)), np.float64) * 100 / 255
    return from_lab(lab)


def clahe(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Tile histograms, clipped with the excess spread evenly, as tables between which pixels interpolate."""
    h, w = gray.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    ny, nx = -(-h // th), -(-w // tw)
    table = np.zeros((ny, nx, 256))
    for i in range(ny):
        for j in range(nx):
            part = gray[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
            hist = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            top = max(1.0, clip * part.size / 256)
            hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / 256
            table[i, j] = np.cumsum(hist) * 255 / part.size
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, ny - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, nx - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda a, b: table[a[:, None], b[None], gray]
    return np.clip(np.rint((at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy), 0, 255).astype(np.uint8)


def ciede2000(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    l1, a1, b1 = np.moveaxis(np.asarray(a, np.float64), -1, 0)
    l2, a2, b2 = np.moveaxis(np.asarray(b, np.float64), -1, 0)
    mean = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2
    g = 0.5 * (1 - np.sqrt(mean**7 / (mean**7 + 25.0**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    flat = c1 * c2 == 0
    dh = np.where(flat, 0, (h2 - h1 + 180) % 360 - 180)
    dh = np.where(~flat & (dh == -180) & (h2 > h1), 180, dh)
    dl, dc, big = l2 - l1, c2 - c1, 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh) / 2)
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    hm = np.where(flat, h1 + h2, np.where(np.abs(h1 - h2) <= 180, (h1 + h2) / 2, np.where(h1 + h2 < 360, (h1 + h2 + 360) / 2, (h1 + h2 - 360) / 2)))
    r = np.radians
    t = 1 - 0.17 * np.cos(r(hm - 30)) + 0.24 * np.cos(r(2 * hm)) + 0.32 * np.cos(r(3 * hm + 6)) - 0.2 * np.cos(r(4 * hm - 63))
    sl = 1 + 0.015 * (lm - 50) ** 2 / np.sqrt(20 + (lm - 50) ** 2)
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    rt = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(r(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    return np.sqrt((dl / sl) ** 2 + (dc / sc) ** 2 + (big / sh) ** 2 + rt * dc / sc * big / sh)


# filters, masks and proxies


def guided(gray: np.ndarray, radius: int = 4, epsilon: float = 1e-3) -> np.ndarray:
    """The self-guided filter of a map in [0, 1]."""
    mean = box(gray, radius)
    var = box(gray * gray, radius) - mean**2
    k = var / (var + epsilon)
    return box(k, radius) * gray + box((1 - k) * mean, radius)


def bilateral(gray: np.ndarray, radius: int = 2, space: float = 2.0, tone: float = 0.1) -> np.ndarray:
    total, weight = np.zeros(gray.shape), np.zeros(gray.shape)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            other = shifted(gray, dy, dx)
            k = np.exp(-(dy * dy + dx * dx) / (2 * space**2) - (other - gray) ** 2 / (2 * tone**2))
            total, weight = total + k * other, weight + k
    return total / weight


def filtered(image: np.ndarray, kind: str, size: int = 3) -> np.ndarray:
    """The named filters; an unknown name lists them."""
    size |= 1
    each = lambda f: as_bytes(np.stack([f(as_unit(image)[..., c]) for c in range(3)], -1))
    kinds = {
        "none": lambda: np.asarray(image),
        "median": lambda: np.stack([median_filter(image[..., c], size) for c in range(3)], -1),
        "gaussian": lambda: each(lambda a: gaussian(a, 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2)),
        "bilateral": lambda: each(lambda a: bilateral(a, size // 2)),
        "guided": lambda: each(lambda a: guided(a, size // 2)),
    }
    if kind not in kinds:
        raise ValueError(f"unknown filter {kind!r}; known: {', '.join(sorted(kinds))}")
    return kinds[kind]()


def shading_corrected(image: np.ndarray, sigma: float = 25.0) -> np.ndarray:
    g = luminance(image) / 255
    light = gaussian(g, sigma)
    return as_bytes(as_unit(image) * (light.mean() / np.maximum(light, 1e-3))[..., None])


def black_frame(image: np.ndarray, threshold: float = 20.0, least: float = 0.01) -> np.ndarray:
    dark = luminance(image) <= threshold
    label = label_components(dark)
    edge = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
    out = np.isin(label, edge[edge > 0])
    return out if out.mean() >= least else np.zeros_like(out)


def vignette(height: int, width: int, limit: float = 0.95) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    r = np.hypot((y - (height - 1) / 2) / max(height / 2, 1), (x - (width - 1) / 2) / max(width / 2, 1))
    return r > limit


def specular(image: np.ndarray, value: float = 0.9, saturation: float = 0.2) -> np.ndarray:
    f = as_unit(image)
    top, low = f.max(-1), f.min(-1)
    return (top >= value) & ((top - low) / np.maximum(top, 1e-6) <= saturation)


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    rows = lambda x, t: correlate_rows(x, t)
    cols = lambda x, t: correlate_rows(x.T, t).T
    a = np.asarray(a, np.float64)
    return cols(rows(a, slope), smooth), rows(cols(a, slope), smooth)


def saliency(image: np.ndarray, border: float = 0.1) -> np.ndarray:
    f = as_unit(image)
    ring = border_ring(f.shape[:2], border)
    return as_unit(stretch(np.linalg.norm(f - np.median(f[ring], axis=0), axis=-1)))


def border_ring(shape: tuple[int, int], share: float) -> np.ndarray:
    h, w = shape
    b = max(1, int(round(min(h, w) * share)))
    out = np.ones(shape, bool)
    out[b : h - b, b : w - b] = False
    return out


def local_binary(image: np.ndarray) -> np.ndarray:
    g = luminance(image)
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    return sum((shifted(g, dy, dx) >= g).astype(np.uint8) << i for i, (dy, dx) in enumerate(ring)).astype(np.uint8)


def gabor(image: np.ndarray, size: int = 9, sigma: float = 3.0, wave: float = 6.0, aspect: float = 0.5) -> np.ndarray:
    """The largest response of four directions, stretched."""
    g, r, out = luminance(image), size // 2, 0.0
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    for angle in np.arange(4) * np.pi / 4:
        along, across = x * np.cos(angle) + y * np.sin(angle), -x * np.sin(angle) + y * np.cos(angle)
        k = np.exp(-(along**2 + (aspect * across) ** 2) / (2 * sigma**2)) * np.cos(2 * np.pi * along / wave)
        out = np.maximum(out, np.abs(sum(k[i, j] * shifted(g, i - r, j - r) for i in range(size) for j in range(size))))
    return stretched(out)


def stretched(values: np.ndarray) -> np.ndarray:
    """The range of the values as 0 to 255; a flat map is 0."""
    low, high = values.min(), values.max()
    return np.rint((values - low) / (high - low) * 255).astype(np.uint8) if high > low else np.zeros(values.shape, np.uint8)


def wavelet_energy(image: np.ndarray) -> np.ndarray:
    """What a level of a pyramid of five binomial taps takes away, stretched."""
    g, taps = luminance(image), np.array([1, 4, 6, 4, 1]) / 16
    small = separable(g, taps)[::2, ::2]
    spread = np.zeros(g.shape)
    spread[::2, ::2] = small
    return stretched(np.abs(g - 4 * separable(spread, taps)))


def dark_artifacts(image: np.ndarray, size: int = 9, threshold: float = 10.0) -> np.ndarray:
    """Thin dark structures: closing less the image, over the threshold; gaps in them are closed by a cross."""
    g, r = luminance(image), max(3, size | 1) // 2
    closed = neighbourhood(neighbourhood(g, r).max(0), r).min(0)
    mask = closed - g > threshold
    cross = lambda m, fill: np.stack([m, *(shifted(m, dy, dx, fill) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))])
    return cross(cross(mask, False).any(axis=0), True).all(axis=0)


def unsharp(image: np.ndarray, amount: float = 0.5, sigma: float = 1.0) -> np.ndarray:
    f = as_unit(image)
    return as_bytes(f + amount * (f - np.stack([gaussian(f[..., c], sigma) for c in range(3)], -1)))


# restoration


def noise_sigma(gray: np.ndarray) -> float:
    """Immerkaer's estimate from a second-difference mask."""
    g = np.asarray(gray, np.float64)
    second = lambda a: shifted(a, 0, -1) - 2 * a + shifted(a, 0, 1)
    return float(np.sqrt(np.pi / 2) * np.abs(second(second(g).T)).mean() / 6)


def wiener(gray: np.ndarray, size: int = 5, sigma: float | None = None, blend: float = 1.0) -> np.ndarray:
    g = np.asarray(gray, np.float64)
    mean = box(g, size // 2)
    var = np.maximum(box(g * g, size // 2) - mean**2, 0)
    noise = (noise_sigma(g) if sigma is None else sigma) ** 2
    out = mean + np.maximum(var - noise, 0) / np.maximum(var, max(noise, 1e-12)) * (g - mean)
    return (1 - blend) * g + blend * out


def deblock(gray: np.ndarray, block: int = 8, strength: float = 0.5, least: float = 2.0, most_activity: float = 12.0) -> np.ndarray:
    """Softens jumps over block borders where both sides are calm: columns first, then rows."""
    def columns(a: np.ndarray) -> np.ndarray:
        a = a.copy()
        for x in range(block, a.shape[1], block):
            p, q = a[:, x - 1].copy(), a[:, x].copy()
            calm = np.maximum(np.abs(p - a[:, x - 2]), np.abs(q - a[:, min(x + 1, a.shape[1] - 1)])) <= most_activity
            d = np.where(calm & (np.abs(q - p) >= least), (q - p) * strength / 2, 0)
            a[:, x - 1], a[:, x] = p + d, q - d
        return a

    return columns(columns(np.asarray(gray, np.float64)).T).T


# segmentation


def boundary(mask: np.ndarray) -> np.ndarray:
    mask = mask.astype(bool)
    return mask & ~erode(mask)


def boundary_scores(pred: np.ndarray, target: np.ndarray, tolerance: float = 2.0) -> dict[str, float]:
    """Boundary F1, 95th percentile Hausdorff and average symmetric surface distance; the image diagonal if one side is empty."""
    p, t = boundary(pred), boundary(target)
    if not p.any() and not t.any():
        return {"boundary_f1": 1.0, "hd95": 0.0, "assd": 0.0}
    if not p.any() or not t.any():
        far = math.hypot(*pred.shape)
        return {"boundary_f1": 0.0, "hd95": far, "assd": far}
    a, b = distance_to(t)[p], distance_to(p)[t]
    precision, recall = float((a <= tolerance).mean()), float((b <= tolerance).mean())
    f1 = 0.0 if precision + recall == 0 else 2 * precision * recall / (precision + recall)
    both = np.concatenate([a, b])
    return {"boundary_f1": f1, "hd95": float(np.percentile(both, 95)), "assd": float(both.mean())}


def edge_indicator(gray: np.ndarray, sigma: float = 1.0, alpha: float = 50.0) -> np.ndarray:
    gx, gy = sobel(gaussian(gray, sigma))
    return 1 / np.sqrt(1 + alpha * (gx**2 + gy**2))


def active_contour(edge: np.ndarray, start: np.ndarray, steps: int = 20, balloon: int = 0, smoothing: int = 1, threshold: float = 0.5) -> np.ndarray:
    """A morphological geodesic contour: balloon where edges are weak, attraction to edges, majority smoothing."""
    u = start.astype(bool)
    dy, dx = (np.gradient(edge, axis=i) if edge.shape[i] > 1 else np.zeros_like(edge) for i in (0, 1))
    for _ in range(steps):
        if balloon:
            u = np.where(edge > threshold, dilate(u) if balloon > 0 else erode(u), u)
        f = u.astype(np.float64)
        pull = dy * (shifted(f, 1, 0) - shifted(f, -1, 0)) + dx * (shifted(f, 0, 1) - shifted(f, 0, -1))
        u = np.where(pull > 0, True, np.where(pull < 0, False, u))
        for _ in range(smoothing):
            u = neighbourhood(u, 1, False).sum(0) >= 5
    return u


def refine(image: np.ndarray, probability: np.ndarray, threshold: float, least: float = 0.5, most: float = 2.0) -> tuple[np.ndarray, bool]:
    """The contour from a thresholded map, holes filled, the component of most mass; the start again if the area runs away."""
    start = probability >= threshold
    u = fill_holes(active_contour(edge_indicator(luminance(image) / 255), start))
    label = label_components(u)
    if label.any():
        u = label == 1 + np.bincount(label[label > 0] - 1, weights=probability[label > 0]).argmax()
    ratio = u.sum() / max(1, start.sum())
    return (u, False) if least <= ratio <= most else (start, True)


def robust_unit(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    a, b = np.percentile(values[valid], [5, 95]) if valid.any() else (0.0, 0.0)
    return np.zeros(values.shape) if b - a < 1e-9 else np.clip((values - a) / (b - a), 0, 1)


def modulated(image: np.ndarray, strength: float = 0.25, low: float = 0.35, high: float = 0.6) -> tuple[np.ndarray, bool]:
    """Lightness lowered where colour departs from the border's: CIEDE2000 to the border's median, scaled, by hysteresis.

    Left alone (and said so) where the border is mostly artifact or nothing, or nearly everything, stands out.
    """
    lab = to_lab(image)
    ring = border_ring(lab.shape[:2], 0.1)
    usable = ring & ~specular(image) & ~black_frame(image)
    if usable.sum() < 0.2 * ring.sum():
        return np.asarray(image).copy(), False
    score = robust_unit(ciede2000(lab, np.broadcast_to(np.median(lab[usable], axis=0), lab.shape)), np.ones(ring.shape, bool))
    mask = fill_holes(hysteresis(score, low, high))
    if not 0.001 <= mask.mean() <= 0.95:
        return np.asarray(image).copy(), False
    lab[..., 0] *= 1 - strength * score * mask
    return from_lab(lab), True


# likeness


def structural_similarity(x: np.ndarray, y: np.ndarray, blur) -> np.ndarray:
    """Mean over the last two axes, of levels 0 to 255; `blur` gives weighted means around each place."""
    return structural_index(blur(x), blur(y), blur(x * x), blur(y * y), blur(x * y))


#: Constants of the structural similarity of levels 0 to 255.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def structural_index(mx: np.ndarray, my: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """The same of the weighted means of both rasters, their squares and their product."""
    sx, sy, both = mx * mx, my * my, mx * my
    found = 2 * (xy - both) + C2
    both *= 2
    both += C1
    found *= both
    under = (xx - sx) + (yy - sy) + C2
    sx += sy
    sx += C1
    under *= sx
    found /= under
    return found.mean(axis=(-2, -1))


def ssim(a: np.ndarray, b: np.ndarray, side: int = 256) -> float:
    """Of luminance at side x side, Gaussian window of 11, sigma 1.5."""
    x, y = (resize(luminance(i), side, side, "lanczos") for i in (a, b))
    return float(structural_similarity(x, y, lambda z: gaussian(z, 1.5, 5)))


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def phash(image: np.ndarray, with_mean: bool = False) -> int:
    """Signs of the low 8 x 8 frequencies against their median without the mean: 63 bits, or 64 with the mean's."""
    g = resize(luminance(image), 32, 32, "lanczos")
    d = dct_matrix(32)
    low = (d @ g @ d.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    out = 0
    for b in bits if with_mean else bits[1:]:
        out = out << 1 | int(b)
    return out


# corruptions, by name


def _affine(a: float, pivot: float):
    return lambda f, rng: pivot + a * (f - pivot)


def _light_field(f: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return f * np.linspace(0.6, 1.2, f.shape[1])[None, :, None]


def _jpeg_like(f: np.ndarray, rng: np.random.Generator, step: float = 40.0) -> np.ndarray:
    """Coarse quantisation of 8 x 8 cosine blocks; there is no codec here."""
    d, out = dct_matrix(8), f * 255
    h, w = (f.shape[0] // 8) * 8, (f.shape[1] // 8) * 8
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            for c in range(3):
                k = d @ out[y : y + 8, x : x + 8, c] @ d.T
                out[y : y + 8, x : x + 8, c] = d.T @ (np.rint(k / step) * step) @ d
    return out / 255


CORRUPTIONS = {
    "clean": lambda f, rng: f,
    "low_brightness": lambda f, rng: f * 0.6,
    "low_contrast": _affine(0.5, 0.5),
    "gaussian_noise": lambda f, rng: f + rng.normal(0, 0.05, f.shape),
    "gaussian_blur": lambda f, rng: np.stack([gaussian(f[..., c], 1.0, 2) for c in range(3)], -1),
    "uneven_light": _light_field,
    "jpeg": _jpeg_like,
}


def corrupt(image: np.ndarray, name: str, seed: int = 0) -> np.ndarray:
    if name not in CORRUPTIONS:
        raise ValueError(f"unknown corruption {name!r}; known: {', '.join(sorted(CORRUPTIONS))}")
    return as_bytes(CORRUPTIONS[name](as_unit(image), np.random.default_rng(seed)))
