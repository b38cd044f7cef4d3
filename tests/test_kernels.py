"""Array functions against closed forms and naive loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweir.functions import kernels as K

masks = st.integers(1, 9).flatmap(lambda h: st.integers(1, 9).flatmap(lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


def naive_components(m, connectivity):
    out, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                a, b = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        c, d = a + dy, b + dx
                        if (connectivity == 8 or dy == 0 or dx == 0) and 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and not out[c, d]:
                            out[c, d] = n
                            todo.append((c, d))
    return out


@given(masks, st.sampled_from([4, 8]))
@settings(max_examples=80, deadline=None)
def test_components_equal_a_flood(m, connectivity):
    assert (K.components(m, connectivity) == naive_components(m, connectivity)).all()


@given(masks)
@settings(max_examples=60, deadline=None)
def test_morphology_brackets_the_mask(m):
    small, big = K.erode(m, K.square()), K.dilate(m, K.square())
    assert (small <= m).all() and (m <= big).all()
    assert (K.open_(m, K.square()) <= m).all() and (m <= K.close(m, K.square())).all()


@given(masks)
@settings(max_examples=60, deadline=None)
def test_fill_holes_keeps_the_mask(m):
    assert (m <= K.fill_holes(m)).all()


def test_ring_has_a_hole_and_a_square_none():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    solid = K.shape_features(ring)
    ring[4, 4] = False
    got = K.shape_features(ring)
    assert (got["holes"], got["euler"]) == (1, 0)
    assert (solid["holes"], solid["euler"]) == (0, 1)
    assert solid["solidity"] == pytest.approx(1) and solid["circularity"] == pytest.approx(4 * math.pi * 16 / 16**2)


def test_outline_of_thin_and_single_pixels_ends():
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert K.polygon_area(K.outline(line)) == 0
    assert len(K.outline(np.ones((1, 1), bool))) == 1
    cross = line | line.T[:5, :5].any()
    assert len(K.outline(cross)) > 0


def test_two_discs_are_split_in_two():
    y, x = np.ogrid[:31, :51]
    m = ((y - 15) ** 2 + (x - 15) ** 2 <= 100) | ((y - 15) ** 2 + (x - 33) ** 2 <= 100)
    label = K.split_island(np.zeros(m.shape, np.uint8), m, 0.6)
    assert label.max() == 2 and not (label[~m] > 0).any()


def test_flat_and_tiny_images():
    flat = np.full((6, 7), 9, np.uint8)
    assert K.otsu(flat) == 0 and not K.stretch(flat).any() and not K.entropy_map(flat).any()
    assert not K.frequency_filter(flat, "high_ideal", 2).any()
    one = np.full((1, 1), 5, np.uint8)
    for name, step in K.STEPS.items():
        assert step(one).shape == (1, 1), name
        assert step(flat).dtype == np.uint8, name
    assert not K.canny(one).any()


def test_unknown_filter_kind_fails():
    with pytest.raises(ValueError, match="unknown filter kind"):
        K.frequency_filter(np.zeros((4, 4), np.uint8), "sideways")


def test_cosine_passes_or_is_removed():
    x = np.arange(32)
    a = np.tile(np.round(100 + 80 * np.cos(2 * np.pi * 4 * x / 32)), (32, 1)).astype(np.uint8)
    assert K.frequency_filter(a, "high_ideal", 3).std() > 50
    assert K.frequency_filter(a, "high_ideal", 25).std() < 60


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=15, deadline=None)
def test_naive_loops(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    p = np.pad(a, 6, mode="symmetric")
    e = np.zeros(a.shape)
    for y in range(9):
        for x in range(11):
            n = np.bincount(p[y : y + 13, x : x + 13].ravel(), minlength=256) / 169
            e[y, x] = -(n[n > 0] * np.log2(n[n > 0])).sum()
    assert (K.entropy_map(a) == np.floor(e + 1e-9)).all()
    m = a > 100
    d = K.chamfer(m)
    if not m.all():
        zeros = np.argwhere(~m)
        for y, x in np.argwhere(m):
            exact = np.hypot(*(zeros - (y, x)).T).min()
            assert abs(d[y, x] - exact) <= 0.1 * exact + 1e-9
    lo, hi = sorted((int(v) for v in rng.integers(0, 256, 2)))
    assert lo <= 255 and hi <= 255
    best = max(range(256), key=lambda t: ((w0 := (a <= t).mean()) * (1 - w0) * (a[a <= t].mean() - a[a > t].mean()) ** 2 if 0 < (a <= t).sum() < a.size else 0, -t))
    assert K.otsu(a) == best


def test_shares_sum_to_one():
    rng = np.random.default_rng(3)
    a, m = rng.integers(0, 256, (12, 15)).astype(np.uint8), rng.random((12, 15)) > 0.4
    s = K.spectrum_features(a, m)
    assert s["energy_low"] + s["energy_mid"] + s["energy_high"] == pytest.approx(1) and 0 <= s["spectral_entropy"] <= 1


def test_median_and_derivatives_by_loops():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (7, 8)).astype(np.uint8)
    p, e = np.pad(a.astype(int), 1, mode="reflect"), np.pad(a, 1, mode="edge")
    gx, gy = K.gradient(a)
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    for y in range(7):
        for x in range(8):
            box = p[y : y + 3, x : x + 3]
            assert gx[y, x] == (box * kx).sum() and gy[y, x] == (box * kx.T).sum()
            assert K.laplacian(a)[y, x] == box[0, 1] + box[2, 1] + box[1, 0] + box[1, 2] - 4 * box[1, 1]
            assert K.median_window(a, 3)[y, x] == np.median(e[y : y + 3, x : x + 3])


def test_two_bands_equal_the_shares():
    rng = np.random.default_rng(4)
    a, m = rng.integers(0, 256, (12, 15)).astype(np.uint8), rng.random((12, 15)) > 0.4
    s = K.spectrum_features(a, m)
    assert K.two_band_ratio(a, m) == pytest.approx(s["fft_ratio"]) and K.two_band_ratio(a, ~(m | True)) == 0


@given(masks)
@settings(max_examples=60, deadline=None)
def test_runs_and_boxes_of_labels(m):
    label = naive_components(m, 4)
    n, y, x0, x1 = K.label_runs(label)
    back = np.zeros(m.shape, int)
    for k, r, a, b in zip(n, y, x0, x1, strict=True):
        back[r, a:b] = k
    assert (back == label).all()
    for k, area, box in K.label_boxes(label):
        assert (label == k).sum() == area == (label[box] == k).sum() and (label[box] == k).any(axis=0)[[0, -1]].all() and (label[box] == k).any(axis=1)[[0, -1]].all()
    assert len(K.label_boxes(label)) == label.max()


def test_frequency_steps_are_the_filters():
    a = np.random.default_rng(6).integers(0, 256, (9, 8)).astype(np.uint8)
    for kind in K.FREQUENCY_KINDS:
        assert (K.STEPS[f"frequency_{kind}"](a, fc=2.0, low=1.0, high=3.0, order=2.0) == K.frequency_filter(a, kind, 2, 1, 3, 2)).all()
