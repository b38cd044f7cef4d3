"""Array functions that raster jobs run per image or per region. Pure: arrays in, arrays or numbers out.

Gray images are 2-D uint8 arrays, masks boolean. Borders: ``mirror`` (the edge pixel isn't repeated) for smoothing and
derivatives, ``symmetric`` for the entropy window, nothing outside for morphology.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = 1e-8
#: Row half-widths of elliptic structuring elements (fixed values, by size).
ELLIPSE = {5: (0, 2, 2, 2, 0), 9: (0, 3, 3, 4, 4, 4, 3, 3, 0)}
#: Chamfer weights of a 5 x 5 distance transform: straight, diagonal, knight's move (fixed values).
CHAMFER = (1.0, 1.4, 2.1969)


def square(k: int = 3) -> list[tuple[int, int]]:
    """Offsets of a k x k element."""
    r = k // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic element of size 5 or 9."""
    return [(i - k // 2, dx) for i, w in enumerate(ELLIPSE[k]) for dx in range(-w, w + 1)]


def stretch(a: np.ndarray) -> np.ndarray:
    """Min-max to 0..255, truncated; constant arrays (within rounding noise) become 0."""
    a = np.asarray(a, float)
    lo, hi = a.min(), a.max()
    if hi - lo <= 1e-9 * max(1.0, abs(hi)):
        return np.zeros(a.shape, np.uint8)
    return np.floor((a - lo) * (255.0 / (hi - lo)) + 1e-9).astype(np.uint8)


def clip_bytes(a: np.ndarray, *, rounded: bool = False) -> np.ndarray:
    """0..255, truncated or rounded."""
    return np.clip(np.rint(a) if rounded else np.floor(a + 1e-9), 0, 255).astype(np.uint8)


def _mirror(a: np.ndarray, r: int) -> np.ndarray:
    return np.pad(a, r, mode="reflect")


# ---- smoothing, derivatives, rank filters -----------------------------------------------------------------------------


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, radius ceil(3 sigma), mirrored edges, in double precision."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2.0 * sigma * sigma))
    k /= k.sum()
    p = _mirror(np.asarray(a, float), r)
    rows = sum(k[i] * p[i : i + a.shape[0], :] for i in range(2 * r + 1))
    return sum(k[i] * rows[:, i : i + a.shape[1]] for i in range(2 * r + 1))


def median_window(a: np.ndarray, k: int) -> np.ndarray:
    """Median of a k x k window; edge pixels are repeated outside."""
    return np.median(sliding_window_view(np.pad(a, k // 2, mode="edge"), (k, k)), axis=(2, 3)).astype(np.uint8)


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 Sobel derivatives in x and y."""
    p = _mirror(np.asarray(a, float), 1)
    h, w = a.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return gx, gy


def laplacian(a: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours minus four times the pixel."""
    p = _mirror(np.asarray(a, float), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def box_sum(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over all k x k windows that fit."""
    c = np.pad(np.cumsum(np.cumsum(a, axis=0), axis=1), ((1, 0), (1, 0)))
    return c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]


def entropy_map(a: np.ndarray, k: int = 13) -> np.ndarray:
    """Whole bits of the Shannon entropy in a k x k window with symmetric edges; one box sum per gray level."""
    p = np.pad(a, k // 2, mode="symmetric")
    total = np.zeros(a.shape)
    for v in np.unique(a):
        n = box_sum((p == v).astype(np.int64), k)
        total += np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0.0)
    return np.floor(np.log2(k * k) - total / (k * k) + 1e-9).astype(np.uint8)


def frequency_filter(a: np.ndarray, kind: str, fc: float = 30, low: float = 10, high: float = 80, order: int = 2) -> np.ndarray:
    """Filtered magnitude as bytes. kind: {high,low}_{ideal,butterworth,gaussian} or band. Unknown kinds raise."""
    h, w = a.shape
    y, x = np.ogrid[:h, :w]
    d = np.hypot(y - h // 2, x - w // 2)
    soft = np.exp(-(d * d) / (2.0 * fc * fc))
    gains = {
        "high_ideal": lambda: d >= fc,
        "low_ideal": lambda: d <= fc,
        "high_gaussian": lambda: 1 - soft,
        "low_gaussian": lambda: soft,
        "high_butterworth": lambda: 1 / (1 + (fc / (d + EPS)) ** (2 * order)),
        "low_butterworth": lambda: 1 / (1 + (d / fc) ** (2 * order)),
        "band": lambda: (d >= low) & (d <= high),
    }
    if kind not in gains:
        raise ValueError(f"unknown filter kind {kind!r}; known: {', '.join(gains)}")
    spectrum = np.fft.fftshift(np.fft.fft2(np.asarray(a, float))) * gains[kind]()
    out = np.abs(np.fft.ifft2(np.fft.ifftshift(spectrum)))
    return stretch(np.where(out < 1e-9 * max(1.0, float(a.max())), 0.0, out))


# ---- steps of an adaptive plan ------------------------------------------------------------------------------------------


def homomorphic(a: np.ndarray, sigma: float = 30, gain_low: float = 0.3, gain_high: float = 1.5) -> np.ndarray:
    log = np.log1p(np.asarray(a, float))
    low = smooth(log, max(1.0, sigma))
    return stretch(np.expm1(gain_low * low + gain_high * (log - low)))


def background_subtraction(a: np.ndarray, sigma: float = 50) -> np.ndarray:
    return stretch(np.maximum(0.0, np.asarray(a, float) - np.rint(smooth(a, sigma))))


def bilateral(a: np.ndarray, d: int = 5, sigma_color: float = 25, sigma_space: float = 5) -> np.ndarray:
    r, h, w = int(d) // 2, *a.shape
    p = _mirror(np.asarray(a, float), r)
    top, bottom = np.zeros((h, w)), np.zeros((h, w))
    for dy, dx in square(2 * r + 1):
        if dy * dy + dx * dx <= r * r:
            v = p[r + dy : r + dy + h, r + dx : r + dx + w]
            g = np.exp(-((v - a) ** 2) / (2 * sigma_color**2) - (dy * dy + dx * dx) / (2 * sigma_space**2))
            top, bottom = top + g * v, bottom + g
    return clip_bytes(top / bottom, rounded=True)


def non_local_means(a: np.ndarray, h: float = 10, template: int = 7, search: int = 21) -> np.ndarray:
    """Weights exp(-mean squared patch difference / h^2); one shifted difference and box sum per search offset."""
    t, s = int(template) // 2, int(search) // 2
    rows, cols = a.shape
    p = _mirror(np.asarray(a, float), t + s)
    own = p[s : s + rows + 2 * t, s : s + cols + 2 * t]
    top, bottom = np.zeros(a.shape), np.zeros(a.shape)
    for dy, dx in square(2 * s + 1):
        other = p[s + dy : s + dy + rows + 2 * t, s + dx : s + dx + cols + 2 * t]
        g = np.exp(-np.maximum(0, box_sum((own - other) ** 2, 2 * t + 1)) / (2 * t + 1) ** 2 / (h * h))
        top, bottom = top + g * other[t : t + rows, t : t + cols], bottom + g
    return clip_bytes(top / bottom, rounded=True)


def clahe(a: np.ndarray, clip: float = 2.5, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms of tiles x tiles parts, their mappings bilinearly blended."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > 1 else "edge")
    limit = max(1, int(clip * th * tw / 256))
    luts = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            n[: over % 256] += 1
            luts[i, j] = np.cumsum(n) * (255.0 / (th * tw))
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    side = lambda v: np.clip(v, 0, tiles - 1)
    part = lambda i, j: luts[side(i)[:, None], side(j)[None, :], a]
    out = (1 - fy) * ((1 - fx) * part(y0, x0) + fx * part(y0, x0 + 1)) + fy * ((1 - fx) * part(y0 + 1, x0) + fx * part(y0 + 1, x0 + 1))
    return clip_bytes(out, rounded=True)


def contrast_stretch(a: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    lo, hi = np.percentile(a, [low, high])
    return a if hi <= lo else clip_bytes((a - lo) * 255.0 / (hi - lo))


def gamma(a: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    return np.floor((np.arange(256) / 255.0) ** (1.0 / gamma) * 255 + 1e-9).astype(np.uint8)[a]


def unsharp(a: np.ndarray, strength: float = 1.5, sigma: float = 1.5) -> np.ndarray:
    return clip_bytes((1 + strength) * a - strength * np.rint(smooth(a, sigma)), rounded=True)


def high_boost(a: np.ndarray, factor: float = 1.5, sigma: float = 2.0) -> np.ndarray:
    return clip_bytes(factor * a - np.rint(smooth(a, sigma)))


FREQUENCY_KINDS = ("high_ideal", "high_butterworth", "high_gaussian", "low_ideal", "low_butterworth", "low_gaussian", "band")


def _frequency_step(kind: str):  # noqa: ANN202
    return lambda a, fc=30.0, low=10.0, high=80.0, order=2: frequency_filter(a, kind, fc, low, high, int(order))


#: Steps by name; each takes an image and keyword numbers. By kind: light, noise, contrast, edges, frequency.
STEPS = {
    "background_subtraction": background_subtraction,
    "homomorphic": homomorphic,
    "bilateral": bilateral,
    "gaussian": lambda a, sigma=1.0: clip_bytes(smooth(a, sigma), rounded=True),
    "median": lambda a, k=3: median_window(a, int(k)),
    "non_local_means": non_local_means,
    "clahe": lambda a, clip=2.5, tiles=8: clahe(a, clip, int(tiles)),
    "contrast_stretch": contrast_stretch,
    "gamma": gamma,
    "high_boost": high_boost,
    "unsharp": unsharp,
    **{f"frequency_{kind}": _frequency_step(kind) for kind in FREQUENCY_KINDS},
}


# ---- masks ----------------------------------------------------------------------------------------------------------------


def _shifted(m: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    h, w = m.shape
    out = np.full(m.shape, fill)
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = m[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def dilate(m: np.ndarray, offsets: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    for _ in range(times):
        m = np.logical_or.reduce([_shifted(m, dy, dx, False) for dy, dx in offsets])
    return m


def erode(m: np.ndarray, offsets: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    for _ in range(times):
        m = np.logical_and.reduce([_shifted(m, dy, dx, True) for dy, dx in offsets])
    return m


def close(m: np.ndarray, offsets: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    return erode(dilate(m, offsets, times), offsets, times)


def open_(m: np.ndarray, offsets: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    return dilate(erode(m, offsets, times), offsets, times)


def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Horizontal runs (row, first column, end column) of a mask, in row order."""
    p = np.zeros((m.shape[0], m.shape[1] + 2), np.int8)
    p[:, 1:-1] = m
    step = np.diff(p, axis=1)
    y, x0 = np.nonzero(step == 1)
    return y, x0, np.nonzero(step == -1)[1]


def label_runs(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Horizontal runs (label, row, first column, end column) of all labels over 0, in row order, in one pass."""
    p = np.pad(label, ((0, 0), (1, 1)))
    own, left, right = p[:, 1:-1], p[:, :-2], p[:, 2:]
    y, x0 = np.nonzero((own > 0) & (own != left))
    return label[y, x0], y, x0, np.nonzero((own > 0) & (own != right))[1] + 1


def label_boxes(label: np.ndarray) -> list[tuple[int, int, tuple[slice, slice]]]:
    """(label, pixels, bounding box) of all labels over 0, in order."""
    n, y, x0, x1 = label_runs(label)
    if not len(n):
        return []
    order = np.argsort(n, kind="stable")
    n, y, x0, x1 = n[order], y[order], x0[order], x1[order]
    at = np.flatnonzero(np.diff(n, prepend=n[0] - 1))
    ends = zip(n[at].tolist(), np.add.reduceat(x1 - x0, at).tolist(), *(f.reduceat(v, at).tolist() for f, v in ((np.minimum, y), (np.maximum, y), (np.minimum, x0), (np.maximum, x1))), strict=True)
    return [(k, area, np.s_[a : b + 1, c:d]) for k, area, a, b, c, d in ends]


def components(m: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Label map; 0 is background, regions count from 1 in the order of their first pixel. Union-find over runs."""
    y, x0, x1 = runs(m)
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if connectivity == 8 else 0
    first = np.searchsorted(y, np.arange(m.shape[0] + 1))
    for row in range(1, m.shape[0]):
        i, j = first[row - 1], first[row]
        while i < first[row] and j < first[row + 1]:
            if x0[i] < x1[j] + reach and x0[j] < x1[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    out, names = np.zeros(m.shape, np.int32), {}
    for i in range(len(y)):
        out[y[i], x0[i] : x1[i]] = names.setdefault(root(i), len(names) + 1)
    return out


def large(m: np.ndarray, least: int, connectivity: int = 8) -> np.ndarray:
    """The pixels of regions of at least so many pixels."""
    label = components(m, connectivity)
    size = np.bincount(label.ravel())
    size[0] = 0
    return size[label] >= max(1, least)


def fill_holes(m: np.ndarray) -> np.ndarray:
    """Adds the background that isn't 4-connected to the background pixel at (0, 0); if that's set, all background."""
    outside = components(~m, 4)
    return m | (outside != outside[0, 0]) if not m[0, 0] else np.ones_like(m)


def otsu(a: np.ndarray) -> int:
    """The level that maximises the variance between classes, the first of equals; 0 for one level."""
    n = np.bincount(a.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    ok = (w0 > 0) & (w1 > 0)
    var = np.zeros(256)
    var[ok] = w0[ok] * w1[ok] * (s0[ok] / w0[ok] - s1[ok] / w1[ok]) ** 2
    return int(var.argmax())


def two_maxima(e: np.ndarray) -> np.ndarray:
    """Pixels that have one of the two largest distinct values, and are over 0."""
    return np.isin(e, np.unique(e)[-2:]) & (e > 0)


def chamfer(m: np.ndarray) -> np.ndarray:
    """Distance of set pixels to the nearest unset one by 5 x 5 chamfer weights; infinite if there is none."""
    d = np.where(m, np.inf, 0.0)
    a, b, c = CHAMFER
    steps = [(dy, dx, a if abs(dy) + abs(dx) == 1 else b if abs(dy) == abs(dx) else c) for dy, dx in square(5) if (abs(dy), abs(dx)) in {(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)}]
    while True:
        p, before = np.pad(d, 2, constant_values=np.inf), d
        h, w = d.shape
        d = np.minimum.reduce([d, *[p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] + k for dy, dx, k in steps]])
        if (d == before).all():
            return d


def flood(a: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Watershed by marker flooding: pixels join the marker they are least different from; -1 on lines and on the frame."""
    h, w = a.shape
    label = markers.astype(np.int32).copy()
    label[[0, -1], :] = -1
    label[:, [0, -1]] = -1
    level, queue, n = a.astype(int), [], 0
    queued = np.zeros(a.shape, bool)

    def push(y: int, x: int) -> None:
        nonlocal n
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            v, u = y + dy, x + dx
            if label[v, u] == 0 and not queued[v, u]:
                queued[v, u] = True
                heapq.heappush(queue, (abs(level[v, u] - level[y, x]), n, v, u))
                n += 1

    for y, x in zip(*np.nonzero(label > 0), strict=True):
        push(y, x)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        near = {int(label[y + dy, x + dx]) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))} - {0, -1}
        label[y, x] = near.pop() if len(near) == 1 else -1
        if label[y, x] > 0:
            push(y, x)
    return label


def split_island(a: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Segments of one island: sure core = chamfer distance over share of its maximum; 0 where no segment is."""
    d = chamfer(m)
    core = d > share * d.max() if np.isfinite(d.max()) else m.copy()
    sure = dilate(m, square(3))
    markers = components(core, 8) + 1
    markers[sure & ~core] = 0
    found = flood(a, markers)
    return np.where(m & (found > 1), found - 1, 0)


# ---- regions ----------------------------------------------------------------------------------------------------------------


def outline(m: np.ndarray) -> np.ndarray:
    """Boundary pixel centres (y, x) of the outer contour of one 8-connected region, in order (Moore tracing)."""
    y, x = np.nonzero(m)
    if not len(y):
        return np.zeros((0, 2), int)
    p = np.pad(m, 1)
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    at, back = (int(y[0]) + 1, int(x[0]) + 1), 0
    out, first = [at], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            step = (at[0] + around[d][0], at[1] + around[d][1])
            if p[step]:
                break
        else:
            break  # a single pixel
        if (at, d) == first:
            break
        first = first or (at, d)
        seen = (at[0] + around[(d - 1) % 8][0], at[1] + around[(d - 1) % 8][1])  # the unset pixel looked at before
        at, back = step, around.index((seen[0] - step[0], seen[1] - step[1]))
        out.append(at)
    return np.array(out[:-1] if len(out) > 1 else out) - 1


def polygon_area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull (monotone chain)."""
    pts = sorted({(int(x), int(y)) for y, x in points})
    if len(pts) < 3:
        return np.array([(y, x) for x, y in pts])

    def chain(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array([(y, x) for x, y in chain(pts)[:-1] + chain(pts[::-1])[:-1]])


def perimeter(points: np.ndarray) -> float:
    """Length of the closed outline."""
    return float(np.hypot(*(points - np.roll(points, -1, axis=0)).T).sum()) if len(points) > 1 else 0.0


def shape_features(m: np.ndarray) -> dict[str, float]:
    """solidity, circularity, holes, euler (8-connected components less holes) of a crop mask."""
    label = components(m, 8)
    best, area = np.zeros((0, 2), int), -1.0
    for i, _, box in label_boxes(label):
        line = outline(label[box] == i)
        if (own := polygon_area(line)) > area:
            best, area = line, own
    outer = polygon_area(hull(best)) if len(best) else 0.0
    length = perimeter(best)
    ground = components(~m, 4)
    free = ground != ground[0, 0] if not m[0, 0] else np.ones_like(m)
    holes = int(components(free & ~m, 8).max())
    return {
        "solidity": max(area, 0.0) / (outer + EPS) if outer > EPS else 0.0,
        "circularity": 4 * math.pi * max(area, 0.0) / (length * length) if length > 0 else 0.0,
        "holes": float(holes),
        "euler": float(int(label.max()) - holes),
    }


def value_entropy(v: np.ndarray) -> float:
    n = np.bincount(v.ravel())
    p = n[n > 0] / (v.size + EPS)
    return float(-(p * np.log2(p + EPS)).sum())


def intensity_features(v: np.ndarray) -> dict[str, float]:
    """mean, std, cv, iqr, median and entropy of an object's gray values."""
    mean, std = float(v.mean()), float(v.std())
    low, mid, high = np.percentile(v, [25, 50, 75])
    return {"mean": mean, "std": std, "cv": std / (abs(mean) + EPS), "iqr": float(high - low), "median": float(mid), "entropy": value_entropy(v)}


def contrast_features(v: np.ndarray, ring: np.ndarray) -> dict[str, float]:
    """Object against ring: mean difference, ratio of deviations, entropy difference; zeros without a ring."""
    if not ring.size:
        return dict.fromkeys(("contrast_mean", "contrast_std", "contrast_entropy"), 0.0)
    return {"contrast_mean": float(v.mean() - ring.mean()), "contrast_std": float(v.std() / (ring.std() + EPS)), "contrast_entropy": value_entropy(v) - value_entropy(ring)}


def glcm_features(a: np.ndarray, levels: int = 32) -> dict[str, float]:
    """Co-occurrence of quantised levels at distance 1 in 4 directions, symmetric, normalised; five properties, averaged.

    Correlation is 1 where a direction's level doesn't vary; directions without pairs count as 0 in the averages except
    correlation, where they count as 1.
    """
    q = np.minimum(a.astype(np.int64) * levels // 256, levels - 1)
    h, w = q.shape
    i, j = np.mgrid[:levels, :levels].astype(float)
    out = np.zeros(5)
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        here, there = q[: h - dy, max(0, -dx) : w - max(0, dx)], q[dy:, max(0, dx) : w - max(0, -dx)]
        n = np.bincount((here * levels + there).ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
        n += n.T
        if not (t := n.sum()):
            out += (0, 0, 0, 0, 1)
            continue
        mean = (n * i).sum() / t
        var = (n * i * i).sum() / t - mean * mean
        corr = 1.0 if var < 1e-15 else ((n * i * j).sum() / t - mean * mean) / var
        out += ((n * (i - j) ** 2).sum() / t, (n * np.abs(i - j)).sum() / t, (n / (1 + (i - j) ** 2)).sum() / t, np.sqrt((n * n).sum()) / t, corr)
    return dict(zip(("glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation"), (out / 4).tolist(), strict=True))


def lbp_features(a: np.ndarray, m: np.ndarray) -> dict[str, float]:
    """Uniform local binary patterns (8 points, radius 1) of object pixels in filled crops: uniformity and entropy of 10 bins.

    Diagonal points are bilinear; outside the crop is 0. Differences are rounded to 1e-9 before they are compared, so
    flat areas can't flip.
    """
    if not m.any():
        return {"lbp_uniformity": 0.0, "lbp_entropy": 0.0}
    p, r = np.pad(a.astype(float), 1), 0.5**0.5
    h, w = a.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w][m]
    c = at(0, 0)
    bits = []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)):
        v = at(dy, dx) if dy == 0 or dx == 0 else (1 - r) * (1 - r) * c + (1 - r) * r * (at(dy, 0) + at(0, dx)) + r * r * at(dy, dx)
        bits.append(np.round(v - c, 9) >= 0)
    b = np.array(bits, np.int64)
    code = np.where((b != np.roll(b, -1, axis=0)).sum(axis=0) <= 2, b.sum(axis=0), 9)
    n = np.bincount(code, minlength=10)
    share = n[n > 0] / (len(code) + EPS)
    return {"lbp_uniformity": float((share * share).sum()), "lbp_entropy": float(-(share * np.log2(share + EPS)).sum())}


def two_band_ratio(a: np.ndarray, m: np.ndarray, share: float = 0.18) -> float:
    """Energy beyond a share of the largest radius over the energy within it, of the mean-removed object; 0 without pixels."""
    if not m.any():
        return 0.0
    e = np.abs(np.fft.fftshift(np.fft.fft2(np.where(m, np.asarray(a, float) - a[m].mean(), 0.0)))) ** 2
    y, x = np.ogrid[: e.shape[0], : e.shape[1]]
    r = np.hypot(y - e.shape[0] // 2, x - e.shape[1] // 2)
    low = r <= share * (r.max() + EPS)
    return float(e[~low].sum() / (e[low].sum() + EPS))


def spectrum_features(a: np.ndarray, m: np.ndarray) -> dict[str, float]:
    """Radial energy shares of the mean-removed object, their ratio and the normalised spectral entropy."""
    zero = dict.fromkeys(("fft_ratio", "spectral_entropy", "energy_low", "energy_mid", "energy_high"), 0.0)
    if not m.any():
        return zero
    patch = np.where(m, np.asarray(a, float) - a[m].mean(), 0.0)
    e = np.abs(np.fft.fftshift(np.fft.fft2(patch))) ** 2
    h, w = e.shape
    y, x = np.ogrid[:h, :w]
    r = np.hypot(y - h // 2, x - w // 2)
    top = r.max() + EPS
    band = np.digitize(r, [np.nextafter(0.18 * top, np.inf), np.nextafter(0.45 * top, np.inf)])
    low, mid, high = np.bincount(band.ravel(), weights=e.ravel(), minlength=3)
    total = low + mid + high + EPS
    share = e.ravel() / e.sum() if e.sum() > EPS else np.zeros(0)
    share = share[share > 0]
    ent = float(-(share * np.log2(share + EPS)).sum() / np.log2(e.size + EPS)) if len(share) and e.size > 1 else 0.0
    return {"fft_ratio": (mid + high) / (low + EPS), "spectral_entropy": ent, "energy_low": low / total, "energy_mid": mid / total, "energy_high": high / total}


def canny(a: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: L1 gradient magnitude, non-maximum suppression in four directions, hysteresis by components."""
    gx, gy = gradient(a)
    mag = np.abs(gx) + np.abs(gy)
    p = np.pad(mag, 1)
    h, w = a.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * math.tan(math.pi / 8), ay > ax * math.tan(3 * math.pi / 8)
    same = gx * gy >= 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (mag > before) & (mag >= after) & (mag > low)
    label = components(thin, 8)
    strong = np.unique(label[thin & (mag > high)])
    return np.isin(label, strong[strong > 0])


def edge_features(a: np.ndarray, m: np.ndarray) -> dict[str, float]:
    """Edge density, gradient, Laplacian and Laplacian-of-Gaussian statistics on the object pixels of a filled crop."""
    if not m.any():
        return dict.fromkeys(("edge_density", "gradient_mean", "gradient_std", "laplacian_var", "log_mean", "log_std"), 0.0)
    g = np.hypot(*gradient(a))[m]
    log = np.abs(laplacian(clip_bytes(smooth(a, 1.2), rounded=True)))[m]
    return {
        "edge_density": float((canny(a) & m).sum() / (m.sum() + EPS)),
        "gradient_mean": float(g.mean()),
        "gradient_std": float(g.std()),
        "laplacian_var": float(laplacian(a)[m].var()),
        "log_mean": float(log.mean()),
        "log_std": float(log.std()),
    }
