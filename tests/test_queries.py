"""Every registered query equals its SQL, or plain versions of what it computes."""

import naive
import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from rasterweir.functions import kernels as K
from rasterweir.operators import features, rasters
from rasterweir.plans import registry
from rasterweir.plans.sql import PX

@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.fixture(scope="module")
def rasters_of(spark):
    """The activity rasters as arrays."""
    return {r.image_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in registry.packed(spark, DATA).collect()}


def points_of(frame):
    return {i: set(zip(own["y"].tolist(), own["x"].tolist(), strict=True)) for i, own in frame.groupby("image_id")}


def test_candidate_masks_equal_plain_loops(spark, rasters_of):
    strong, simple = (points_of(registry.QUERIES[n](spark, DATA).toPandas()) for n in ("candidate_mask", "candidate_mask_simple"))
    square, ellipse = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], K.ellipse(5)
    for i, a in rasters_of.items():
        n = naive.high_pass(a, 4)
        over = naive.set_of(n > naive.otsu(n))
        m = over
        for step in (naive.grown, naive.grown, naive.grown, naive.shrunk):
            m = step(m, a.shape, square)
        island = {p for part in naive.parts(m, naive.EIGHT) if len(part) >= 20 for p in part}
        e = np.where(naive.mask_of(island, a.shape), naive.entropy(n), 0)
        assert strong.get(i, set()) == naive.set_of(np.isin(e, sorted(set(e.ravel().tolist()))[-2:]) & (e > 0))
        m = over
        for step in (naive.grown, naive.shrunk, naive.shrunk, naive.shrunk, naive.grown, naive.grown):
            m = step(m, a.shape, ellipse)
        assert simple.get(i, set()) == naive.filled(m, a.shape)


def test_shapes_and_edges_equal_plain_counts(spark, rasters_of):
    """Holes and Euler number by flooding, outlines from 2 x 2 squares, gradient, Laplacian and spectrum by loops over the filled crop."""
    shape = {(r.image_id, r.region_id): r for r in registry.QUERIES["region_shape"](spark, DATA).collect()}
    edges = {(r.image_id, r.region_id): r for r in registry.QUERIES["region_edges"](spark, DATA).collect()}
    spectrum = {(r.image_id, r.region_id): r for r in registry.QUERIES["region_spectrum"](spark, DATA).collect()}
    ratio = {(r.image_id, r.region_id): r.fft_ratio for r in registry.QUERIES["region_band_ratio"](spark, DATA).collect()}
    seen = 0
    for i, a in rasters_of.items():
        for k, part in enumerate(naive.parts(naive.set_of(a > 0), naive.EIGHT), 1):
            if len(part) < 4:
                continue
            seen += 1
            ys, xs = zip(*part, strict=True)
            y0, y1, x0, x1 = max(0, min(ys) - 3), min(a.shape[0], max(ys) + 4), max(0, min(xs) - 3), min(a.shape[1], max(xs) + 4)
            own = {(y - y0, x - x0) for y, x in part}
            m = naive.mask_of(own, (y1 - y0, x1 - x0))
            crop = np.where(m, a[y0:y1, x0:x1], int(np.median([a[p] for p in part]))).astype(int)
            holes = len(naive.parts(naive.filled(own, m.shape) - own, naive.EIGHT))
            assert (shape[i, k].holes, shape[i, k].euler) == (holes, 1 - holes)
            (area, length), outer = naive.outline_measures(own, m.shape), naive.hull_area(own)
            assert shape[i, k].solidity == pytest.approx(area / outer if outer else 0, abs=2e-6)
            assert shape[i, k].circularity == pytest.approx(4 * np.pi * area / length**2, abs=2e-6)
            p, grad, lap = np.pad(crop, 1, mode="reflect"), [], []
            for y, x in own:
                box = p[y : y + 3, x : x + 3]
                gx, gy = (box[:, 2] - box[:, 0]) @ [1, 2, 1], (box[2] - box[0]) @ [1, 2, 1]
                grad.append(np.hypot(gx, gy))
                lap.append(box[0, 1] + box[2, 1] + box[1, 0] + box[1, 2] - 4 * box[1, 1])
            r = edges[i, k]
            assert (r.gradient_mean, r.gradient_std, r.laplacian_var) == pytest.approx((np.mean(grad), np.std(grad), np.var(lap)), abs=2e-6)
            s = spectrum[i, k]
            low, mid, high, spread = naive.spectrum(crop, own)
            assert (s.energy_low, s.energy_mid, s.energy_high, s.spectral_entropy) == pytest.approx((low, mid, high, spread), abs=1e-5)
            if low > 1e-6:
                assert s.fft_ratio == pytest.approx((mid + high) / low, rel=1e-4)
            else:  # nothing at all, or nothing in the lowest band
                assert s.fft_ratio == 0 if mid + high == 0 else s.fft_ratio > 1e6
            assert ratio[i, k] == pytest.approx(s.fft_ratio, rel=1e-6, abs=1e-6)
    assert seen == len(shape) == len(edges)


def test_region_features_are_those_of_the_single_queries(spark):
    """The common map gives what the queries per group give (with their pad), region by region."""
    whole = registry.QUERIES["region_features"](spark, DATA).toPandas().set_index(["image_id", "region_id"]).sort_index()
    crops = features.region_crops(*registry._region_inputs(spark, DATA), features.PAD)
    for part, names in ((features.region_glcm, features.GLCM), (features.region_lbp, features.LBP), (features.region_contrast, features.CONTRAST), (features.region_edges, features.EDGES)):
        own = part(crops).toPandas().set_index(["image_id", "region_id"]).loc[whole.index]
        assert np.allclose(own[names], whole[names], atol=2e-5, rtol=1e-5)


def test_watershed_queries_cover_their_masks(spark, rasters_of):
    got = registry.QUERIES["watershed_mask"](spark, DATA).toPandas()
    for i, own in got.groupby("image_id"):
        a = rasters_of[i]
        assert (a[own["y"], own["x"]] > 0).all() and not own.duplicated(["y", "x"]).any() and own["distance"].between(1, 255).all()
    islands = registry.QUERIES["watershed_islands"](spark, DATA).toPandas()
    for i, own in islands.groupby("image_id"):
        assert sorted(own["region_id"].unique()) == list(range(1, own["region_id"].nunique() + 1)) and (rasters_of[i][own["y"], own["x"]] > 0).all()


def test_filter_queries_equal_their_steps(spark, rasters_of):
    every = registry.QUERIES["apply_all_filters"](spark, DATA).toPandas().set_index("image_id")["total"]
    assert len(every) == len(rasters_of) * len(K.STEPS)
    for i, a in rasters_of.items():
        for name, step in K.STEPS.items():
            assert every[f"{i}:{name}"] == int(step(a).astype(int).sum())
    own = registry.QUERIES["apply_filters"](spark, DATA).toPandas().set_index("image_id")
    assert set(own.index) == set(rasters_of) and (own["status"] == "ok").all()


def test_segmentation_and_classification_queries(spark, rasters_of):
    seg = registry.QUERIES["segment_corpus"](spark, DATA).toPandas()
    assert set(seg["image_id"]) == set(rasters_of) and ((seg["status"] == "ok") == (seg["regions"] > 0)).all() and set(seg["status"]) <= {"ok", "empty"}
    big = {(i, n) for i, a in rasters_of.items() for n, area, _ in K.label_boxes(K.components(rasters.candidate(a, 4, 20, 13), 8)) if area >= 20}
    found = registry.QUERIES["classify_regions"](spark, DATA).collect()
    assert {(r.image_id, r.region_id) for r in found} == big and len(big) > 0 and {r.cls for r in found} <= {0, 1} and all(r.d2 >= 0 for r in found)


def test_training_query(spark):
    h = registry.QUERIES["hlvq_fit"](spark, DATA).toPandas().sort_values("epoch")
    best = int(h["acc_val"].to_numpy().argmax()) - 1
    assert h["epoch"].tolist() == list(range(-1, min(12, best + 6))) and h[["acc_train", "acc_val"]].stack().between(0, 1).all()


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def split_events(tmp_path_factory):
    """Two rasters of 6 x 6 pixels with three values each, the first in one file and the others in another, whose floor depends on the order of adding."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, found = np.random.default_rng(4), []
    while len(found) < 72:
        a, b = (int(v) for v in rng.integers(1, 9000, 2))
        t = [a / 100, b / 100, (-(a + b) % 100 + 100 * int(rng.integers(1, 70))) / 100]
        if int(t[0] + t[1] + t[2]) != int(t[0] + (t[1] + t[2])):
            found.append(t)
    at = [(5 * i, datetime.datetime(2024, 1, 2 + y, 3 + x)) for i in range(2) for y in range(6) for x in range(6)]
    path = tmp_path_factory.mktemp("split") / "events.parquet"
    path.mkdir()
    for part, own in enumerate(([0], [1, 2])):
        rows = [(100 * k + j, ts, user, "click", found[k][j], "{}") for k, (user, ts) in enumerate(at) for j in own]
        columns = dict(zip(("event_id", "ts", "user_id", "event_type", "value", "props"), map(list, zip(*rows, strict=True)), strict=True))
        pq.write_table(pa.table(columns), path / f"part-{part}.parquet")
    return path.parent


@pytest.mark.parametrize("name", ["contrast_stretch", "gamma_lut", "image_profile", "labelled_dataset", "median_filter", "minmax_norm", "region_gradient", "region_intensity", "region_pixels", "top2_values"])
def test_rasters_do_not_depend_on_files_and_tasks(spark, split_events, name):
    """Values at a whole number are added as one sweep over the files would, as the SQL does in one thread."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{split_events}/events.parquet/*.parquet'")
    assert rows_of(registry.QUERIES[name](spark, str(split_events)).toPandas()) == rows_of(con.sql(registry.SQL[name]).df())


def test_rasters_with_nulls_and_repeated_rows(spark, tmp_path):
    """Null values are left out, null users and times are a raster and a place of their own, and the cap holds."""
    import duckdb

    rows = [(1, None, None, 0.3), (1, "2024-01-02 03:00:00", 5, None), (2, "2024-01-02 03:00:00", 6, 0.7), (2, "2024-01-02 03:00:00", 6, 0.3), (3, "2024-01-02 04:00:00", 6, None), (4, "2024-01-02 05:00:00", 6, 300.5), (5, None, None, 0.7)]
    rows += [(6, "2024-01-02 06:00:00", 7, 0.1)] * 10 + [(7, "2024-01-02 07:00:00", 7, -0.1)] * 10
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.connect().sql(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet'), {PX} SELECT * FROM px").df()
    assert rows_of(registry.px(spark, str(tmp_path)).toPandas()) == rows_of(want)
