"""Plain versions of raster steps: loops and explicit sums, for comparison."""

import numpy as np


def set_of(m):
    return {(int(y), int(x)) for y, x in np.argwhere(m)}


def mask_of(points, shape):
    m = np.zeros(shape, bool)
    for y, x in points:
        m[y, x] = True
    return m


def grown(points, shape, offsets):
    return {(y + dy, x + dx) for y, x in points for dy, dx in offsets if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]}


def shrunk(points, shape, offsets):
    inside = lambda y, x: 0 <= y < shape[0] and 0 <= x < shape[1]
    return {(y, x) for y in range(shape[0]) for x in range(shape[1]) if all((y + dy, x + dx) in points for dy, dx in offsets if inside(y + dy, x + dx))}


def flooded(start, allowed, near):
    seen, todo = {start} & allowed, [start]
    while todo:
        y, x = todo.pop()
        for dy, dx in near:
            p = (y + dy, x + dx)
            if p in allowed and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def parts(points, near):
    left, out = set(points), []
    while left:
        out.append(flooded(min(left), left, near))
        left -= out[-1]
    return out


def filled(points, shape):
    every = {(y, x) for y in range(shape[0]) for x in range(shape[1])}
    return every - (flooded((0, 0), every - points, FOUR) if (0, 0) not in points else set())


def high_pass(a, fc):
    """Ideal high pass by explicit transform matrices, stretched to bytes."""
    h, w = a.shape
    ey, ex = (np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n) for n in (h, w))
    spectrum = ey @ a.astype(float) @ ex
    for ky in range(h):
        for kx in range(w):
            v, u = (ky if ky < h - h // 2 else ky - h), (kx if kx < w - w // 2 else kx - w)
            if np.hypot(v, u) < fc:
                spectrum[ky, kx] = 0
    out = np.abs(ey.conj() @ spectrum @ ex.conj()) / (h * w)
    out[out < 1e-9 * max(1, a.max())] = 0
    lo, hi = out.min(), out.max()
    return np.floor((out - lo) * 255 / (hi - lo) + 1e-9).astype(np.uint8) if hi - lo > 1e-9 * max(1, hi) else np.zeros(a.shape, np.uint8)


def otsu(a):
    def between(t):
        low, high = a[a <= t].astype(float), a[a > t].astype(float)
        return len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0.0

    return max(range(256), key=lambda t: (round(between(t), 3), -t))


def entropy(a, k=13):
    p, out = np.pad(a, k // 2, mode="symmetric"), np.zeros(a.shape, int)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            n = np.unique(p[y : y + k, x : x + k], return_counts=True)[1] / (k * k)
            out[y, x] = int(np.floor(-(n * np.log2(n)).sum() + 1e-9))
    return out


def outline_measures(points, shape):
    """Area within, and length of, the outer outline through pixel centres, from the patterns of all 2 x 2 squares."""
    wide = (shape[0] + 2, shape[1] + 2)  # what lies at the crop's edge is outside, too
    m = mask_of(filled({(y + 1, x + 1) for y, x in points}, wide), wide)
    area = length = 0.0
    for y in range(m.shape[0] - 1):
        for x in range(m.shape[1] - 1):
            box = m[y : y + 2, x : x + 2]
            n, diagonal = int(box.sum()), box[0, 0] == box[1, 1]
            area += {3: 0.5, 4: 1.0}.get(n, 0.0)
            length += {2: 2 * 2**0.5 if diagonal else 1.0, 3: 2**0.5}.get(n, 0.0)
    return area, length


def hull_area(points):
    """Area of the convex hull: a pair of points is a side if all others are left of it or between the two."""
    p, twice = np.array(sorted(points)), 0
    for a in p:
        for b in p:
            side, along = (b - a)[0] * (p - a)[:, 1] - (b - a)[1] * (p - a)[:, 0], (p - a) @ (b - a)
            if (a != b).any() and (side >= 0).all() and ((side > 0) | ((along >= 0) & (along <= (b - a) @ (b - a)))).all():
                twice += int(a[0] * b[1] - a[1] * b[0])
    return abs(twice) / 2


def spectrum(a, points):
    """Energy shares up to 18 % and 45 % of the largest radius and beyond, and spectral entropy, by explicit transform matrices."""
    h, w = a.shape
    patch, mean = np.zeros((h, w)), np.mean([a[p] for p in points])
    for p in points:
        patch[p] = a[p] - mean
    ey, ex = (np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n) for n in (h, w))
    energy = np.abs(ey @ patch @ ex) ** 2
    top = max(np.hypot(v, u) for v in (h // 2, h - 1 - h // 2) for u in (w // 2, w - 1 - w // 2))
    bands, total = [0.0, 0.0, 0.0], energy.sum()
    if total < 1e-6:
        return *bands, 0.0
    for ky in range(h):
        for kx in range(w):
            r = np.hypot(ky if ky < h - h // 2 else h - ky, kx if kx < w - w // 2 else w - kx) / top
            bands[0 if r <= 0.18 else 1 if r <= 0.45 else 2] += energy[ky, kx] / total
    share = energy[energy > total * 1e-18] / total
    return *bands, -(share * np.log2(share)).sum() / np.log2(h * w)
