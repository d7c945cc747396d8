"""Regions of an image: superpixels and what describes them, mean-shift smoothing, and filling by a marching front."""

from __future__ import annotations

import heapq
import math

import numpy as np

from . import kernels

NEAR = ((-1, 0), (0, -1), (0, 1), (1, 0))


def superpixels(image: np.ndarray, many: int, compactness: float = 10.0, steps: int = 10, sigma: float = 0.0) -> np.ndarray:
    """Labels from 0 of about `many` connected regions of like colour, by local k-means in Lab and place.

    Centres begin on a grid of step S; a pixel belongs to the one, of those less than 2S windows off, that is least in
    colour distance ** 2 + (compactness / S * distance) ** 2. Parts that hang apart and are smaller than a quarter of S * S go to
    the neighbour with the longest common border; other parts become regions of their own.
    """
    lab = kernels.to_lab(image)
    if sigma > 0:
        lab = np.stack([kernels.gaussian(lab[..., i], sigma) for i in range(3)], -1)
    h, w = image.shape[:2]
    many = max(1, min(many, h * w))
    step = math.sqrt(h * w / many)
    ys, xs = (np.arange(max(1, round(n / step))) * n / max(1, round(n / step)) + n / max(1, round(n / step)) / 2 - 0.5 for n in (h, w))
    centre = np.array([(*lab[int(round(y)), int(round(x))], y, x) for y in ys for x in xs])
    place = np.stack(np.mgrid[:h, :w], -1).astype(np.float64)
    weight, reach = (compactness / step) ** 2, math.ceil(2 * step)
    label = np.zeros((h, w), np.int64)
    together = len(centre) * h * w <= 1 << 16  # all centres of a small image at once
    for _ in range(steps):
        best = np.full((h, w), np.inf)
        if together:
            to, at = centre[:, None, None], centre[:, 3:].astype(int)[:, None, None]
            d = ((lab - to[..., :3]) ** 2).sum(-1) + weight * ((place - to[..., 3:]) ** 2).sum(-1)
            d[(np.abs(place - at) > reach).any(-1)] = np.inf
            near = np.isfinite(d).any(0)
            label[near] = d.argmin(0)[near]
        for k, (l, a, b, y, x) in enumerate(centre[: 0 if together else None]):
            rows, columns = (slice(max(0, int(v) - reach), int(v) + reach + 1) for v in (y, x))
            d = ((lab[rows, columns] - (l, a, b)) ** 2).sum(-1) + weight * ((place[rows, columns] - (y, x)) ** 2).sum(-1)
            near = d < best[rows, columns]
            best[rows, columns][near] = d[near]
            label[rows, columns][near] = k
        n = np.bincount(label.ravel(), minlength=len(centre))
        values = np.concatenate([lab, place], -1).reshape(-1, 5)
        mean = np.stack([np.bincount(label.ravel(), v, len(centre)) for v in values.T], -1)
        centre[n > 0] = mean[n > 0] / n[n > 0, None]
    return _connected(label, step * step / 4)


def _connected(label: np.ndarray, least: float) -> np.ndarray:
    own = np.arange(label.size).reshape(label.shape)  # a pixel of the same part, at last the first one
    beside = [((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))]
    beside = [(a, b, label[a] == label[b]) for a, b in beside]
    while True:
        new = own.copy()
        for a, b, same in beside:
            for to, of in ((a, b), (b, a)):
                new[to] = np.where(same, np.minimum(new[to], new[of]), new[to])
        new = new.ravel()[new]
        if (new == own).all():
            break
        own = new
    first = np.unique(own)
    first = first[np.argsort(label.ravel()[first], kind="stable")]
    number = np.zeros(label.size, np.int64)
    number[first] = np.arange(1, len(first) + 1)
    parts = number[own]
    while True:
        ids, n = np.unique(parts, return_counts=True)
        small = ids[n < least]
        if not len(small) or len(ids) == 1:
            return np.unique(parts, return_inverse=True)[1].reshape(parts.shape)
        k = small[np.argmin(n[n < least])]
        beside = np.concatenate([np.concatenate([a[(b == k) & (a != k)], b[(a == k) & (b != k)]]) for a, b in ((parts[1:], parts[:-1]), (parts[:, 1:], parts[:, :-1]))])
        neighbours, border = np.unique(beside, return_counts=True)
        parts[parts == k] = neighbours[np.argmax(border)]


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue, saturation and value, each from 0 to 1."""
    f = kernels.as_unit(image)
    top, low = f.max(-1), f.min(-1)
    spread = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(f, -1, 0)
    hue = np.where(top == r, (g - b) / spread % 6, np.where(top == g, (b - r) / spread + 2, (r - g) / spread + 4)) / 6
    return np.stack([np.where(top > low, hue, 0), np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top], -1)


#: The order of a region's description.
NAMES = [f"{space}_{i}_{what}" for space in ("rgb", "lab", "hsv") for what in ("mean", "std") for i in range(3)]
NAMES += ["grey_mean", "grey_std", "gradient_mean", "gradient_std", "area", "centre_y", "centre_x", "from_border", "on_border", "contrast", "like_background", "from_background"]


def described(image: np.ndarray, label: np.ndarray, border: float = 0.1, spatial: float = 0.4, background: float = 0.2) -> np.ndarray:
    """A row of NAMES for each region: colours, gradient, place, and how it stands out from the others and from the image's border.

    Means and deviations of all regions at once, by weighted counts. Lab is scaled to 0 to 1 a component. contrast: the mean
    distance to other regions' Lab, by their area and nearness; from_background: that to the mean of a border of `border` of the
    shorter side.
    """
    h, w = label.shape
    n = np.bincount(label.ravel()).astype(np.float64)
    lab = (kernels.to_lab(image) + (0, 128, 128)) / (100, 255, 255)
    grey = kernels.luminance(image) / 255
    gradient = np.hypot(*kernels.sobel(grey))
    gradient = gradient / gradient.max() if gradient.max() > 1e-8 else gradient
    mean = lambda v: np.bincount(label.ravel(), np.asarray(v, np.float64).ravel(), len(n)) / n
    columns = []
    for space in (kernels.as_unit(image), lab, to_hsv(image)):
        means = [mean(space[..., i]) for i in range(3)]
        columns += means + [np.sqrt(mean((space[..., i] - m[label]) ** 2)) for i, m in enumerate(means)]
    for v in (grey, gradient):
        m = mean(v)
        columns += [m, np.sqrt(mean((v - m[label]) ** 2))]
    y, x = np.mgrid[:h, :w]
    cy, cx = (mean(y) + 0.5) / h, (mean(x) + 0.5) / w
    rim = (y == 0) | (y == h - 1) | (x == 0) | (x == w - 1)
    columns += [n / (h * w), cy, cx, 2 * np.minimum.reduce([cy, cx, 1 - cy, 1 - cx]), mean(rim) * np.sqrt(n)]
    own = np.stack(columns[6:9], -1)
    apart = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1) / 3)
    weight = n / n.sum() * np.exp(-((cy[:, None] - cy) ** 2 + (cx[:, None] - cx) ** 2) / (2 * spatial**2))
    np.fill_diagonal(weight, 0)
    total = weight.sum(1)
    contrast = np.where(total > 1e-12, (weight * apart).sum(1) / np.where(total > 1e-12, total, 1), 0)
    band = max(1, round(min(h, w) * border))
    around = np.ones((h, w), bool)
    around[band : h - band, band : w - band] = False
    away = np.sqrt(((own - lab[around].mean(0)) ** 2).sum(-1) / 3)
    return np.stack([*columns, contrast, np.exp(-(away**2) / (2 * background**2)), away], -1)


def mean_shift(image: np.ndarray, space: int = 8, colour: float = 18.0, steps: int = 5) -> np.ndarray:
    """Each pixel moves to the mean place and colour of those within `space` pixels and `colour` levels of where it is, and takes that colour.

    All pixels move at once, in parts of bounded size; a pixel rests when it moves by less than a tenth. Where the image has no
    more pixels than the window, each moving pixel looks at all of them, else at its window's; sums of whole levels are exact.
    """
    f = np.asarray(image, np.float64)
    h, w = f.shape[:2]
    everywhere = np.concatenate([f, np.stack(np.mgrid[:h, :w], -1)], -1).reshape(h * w, -1)
    place, tone = np.stack(np.mgrid[:h, :w], -1).astype(np.float64), f.copy()
    live = np.ones((h, w), bool)
    reach = [min(space, n - 1) for n in (h, w)]
    offsets = np.stack(np.mgrid[-reach[0] : reach[0] + 1, -reach[1] : reach[1] + 1], -1).reshape(-1, 2)
    for _ in range(steps):
        now, here = tone[live], place[live]
        found = np.concatenate([now, here], -1)
        for i in range(0, len(now), 2048):
            part = slice(i, i + 2048)
            if h * w <= len(offsets):
                beside = (np.abs(everywhere[:, 3:] - np.rint(here[part])[:, None]) <= reach).all(-1)
                near = beside & (((everywhere[:, :3] - now[part, None]) ** 2).sum(-1) <= colour**2)
                n = near.sum(1)
                found[part] = np.where(n[:, None] > 0, near.astype(np.float64) @ everywhere / np.maximum(n, 1)[:, None], found[part])
                continue
            at = np.rint(here[part]).astype(int)[:, None] + offsets
            inside = ((at >= 0) & (at < (h, w))).all(-1)
            y, x = np.moveaxis(np.clip(at, 0, (h - 1, w - 1)), -1, 0)
            near = inside & (((f[y, x] - now[part, None]) ** 2).sum(-1) <= colour**2)
            n, values = near.sum(1), np.concatenate([f[y, x], y[..., None], x[..., None]], -1)
            mean = (values * near[..., None]).sum(1) / np.maximum(n, 1)[:, None]
            found[part] = np.where(n[:, None] > 0, mean, found[part])
        moved = np.abs(found[:, 3:] - here).sum(-1) + np.abs(found[:, :3] - now).sum(-1)
        tone[live], place[live] = found[:, :3], found[:, 3:]
        live[live] = moved >= 0.1
        if not live.any():
            break
    return np.clip(np.rint(tone), 0, 255).astype(np.uint8)


def boundary_proxy(image: np.ndarray) -> np.ndarray:
    """Gradient of the mean-shifted image's luminance, stretched to 0 to 255."""
    g = np.hypot(*kernels.sobel(kernels.luminance(mean_shift(image))))
    return np.rint((g - g.min()) / (g.max() - g.min()) * 255).astype(np.uint8) if g.max() > g.min() else np.zeros(g.shape, np.uint8)


def _arrival(times: np.ndarray, known: np.ndarray, y: int, x: int) -> float:
    """When a front of speed 1 gets to a pixel from its known neighbours: the upwind solution of |gradient| = 1."""
    h, w = times.shape
    side = lambda *places: min((times[p] for p in places if 0 <= p[0] < h and 0 <= p[1] < w and known[p]), default=math.inf)
    a, b = sorted((side((y - 1, x), (y + 1, x)), side((y, x - 1), (y, x + 1))))
    return a + 1 if b - a >= 1 else (a + b + math.sqrt(2 - (a - b) ** 2)) / 2


def march(mask: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The masked pixels in the order in which a front from outside reaches them, and the times of all (0 outside)."""
    h, w = mask.shape
    times, known = np.where(mask, math.inf, 0.0), ~mask
    front: list[tuple[float, int, int]] = []

    def look(y: int, x: int) -> None:
        for dy, dx in NEAR:
            p = y + dy, x + dx
            if 0 <= p[0] < h and 0 <= p[1] < w and not known[p] and (t := _arrival(times, known, *p)) < times[p]:
                times[p] = t
                heapq.heappush(front, (t, *p))

    for y, x in zip(*np.nonzero(known), strict=True):
        look(y, x)
    order = []
    while front:
        t, y, x = heapq.heappop(front)
        if not known[y, x]:
            known[y, x] = True
            order.append((y, x))
            look(y, x)
    return order, times


def filled(image: np.ndarray, mask: np.ndarray, radius: int = 3, most: float | None = 0.2) -> np.ndarray:
    """Masked pixels from known ones within `radius`, in the order of march(): near ones, ones along the front's way and ones as late count more.

    Each known neighbour gives its colour carried on along its own gradient (of known pixels). Left alone where nothing, all or
    more than `most` is masked.
    """
    mask = np.asarray(mask, bool)
    if not mask.any() or mask.all() or most is not None and mask.mean() > most:
        return np.asarray(image).copy()
    out, known = np.asarray(image, np.float64).copy(), ~mask
    h, w = mask.shape
    order, times = march(mask)
    slope_y, slope_x = (np.gradient(times, axis=k) if times.shape[k] > 1 else np.zeros(times.shape) for k in (0, 1))
    for y, x in order:
        total, weight = np.zeros(out.shape[2]), 0.0
        for v in range(max(0, y - radius), min(h, y + radius + 1)):
            for u in range(max(0, x - radius), min(w, x + radius + 1)):
                dy, dx = y - v, x - u
                if not known[v, u] or dy * dy + dx * dx > radius * radius:
                    continue
                along = abs(dy * slope_y[y, x] + dx * slope_x[y, x]) / math.hypot(dy, dx)
                share = max(along, 1e-6) / (dy * dy + dx * dx) / (1 + abs(times[v, u] - times[y, x]))
                drift = np.zeros(out.shape[2])
                for step, (a, b) in ((dy, ((v - 1, u), (v + 1, u))), (dx, ((v, u - 1), (v, u + 1)))):
                    a, b = (p if 0 <= p[0] < h and 0 <= p[1] < w and known[p] else (v, u) for p in (a, b))  # noqa: PLW2901
                    if a != b:
                        drift += step * (out[b] - out[a]) / (abs(b[0] - a[0]) + abs(b[1] - a[1]))
                total += share * (out[v, u] + drift)
                weight += share
        out[y, x] = np.clip(total / weight, 0, 255) if weight else 0
        known[y, x] = True
    return np.rint(out).astype(np.uint8)
