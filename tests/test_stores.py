"""Stores, statistics that merge, headers, and crops by parts of an image."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweir.operators import corpus_stats, features, model, qc
from rasterweir.sources import headers, images, sinks, store

RUNS = "image_id int, region_id int, y int, x0 int, x1 int"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def files_of(spark, path, name, snapshot=None):
    return {b: sorted(os.listdir(f"{path}/{f}")) for b, f in store.manifest(spark, path, snapshot)["tables"][name]["folders"].items()}


def test_a_merge_touches_the_buckets_of_its_images_only(spark, tmp_path):
    path = str(tmp_path)
    base = spark.createDataFrame([(i, 1, 0, 0, i + 1) for i in range(40)] + [(None, 9, 0, 0, 1)], RUNS)
    assert store.merge(path, {"label_runs": base}, buckets=8) == 0
    before = files_of(spark, path, "label_runs")
    pinned = store.read(spark, path, "label_runs")
    new = spark.createDataFrame([(3, 7, 1, 1, 2), (3, 8, 1, 4, 5), (100, 1, 0, 0, 1)], RUNS)
    assert store.merge(path, {"label_runs": new}) == 1
    want = [tuple(r) for r in base.collect() if r.image_id != 3] + [tuple(r) for r in new.collect()]
    assert rows(store.read(spark, path, "label_runs")) == sorted(want, key=str)
    assert rows(pinned) == rows(base) == rows(store.read(spark, path, "label_runs", 0))  # readers keep their snapshot
    after = files_of(spark, path, "label_runs")
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) == len({r[0] for r in new.select(store._bucket(8)).distinct().collect()}) < 8 and len(after) - len(changed) >= 5
    assert store.merge(path, {"label_runs": new.limit(0)}, spark.createDataFrame([(3,), (None,)], "image_id int")) == 2
    assert rows(store.read(spark, path, "label_runs")) == sorted([r for r in want if r[0] not in (3, None)], key=str)
    with pytest.raises(ValueError, match="other columns"):
        store.merge(path, {"label_runs": new.withColumn("more", F.lit(1))})
    with pytest.raises(ValueError, match="no table"):
        store.read(spark, path, "regions")


def test_a_writer_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    base = spark.createDataFrame([(i, 1, 0, 0, 1) for i in range(10)], RUNS)
    store.merge(path, {"label_runs": base}, buckets=4)
    held = store._commit

    def crash(*_):
        raise OSError("lost between files and switch")

    monkeypatch.setattr(store, "_commit", crash)
    with pytest.raises(OSError, match="lost"):
        store.merge(path, {"label_runs": base.withColumn("region_id", F.lit(5))})
    assert rows(store.read(spark, path, "label_runs")) == rows(base) and store.snapshots(spark, path) == [0]
    monkeypatch.setattr(store, "_commit", held)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(spark, path, 0, {})
    assert store.merge(path, {"label_runs": base.withColumn("region_id", F.lit(5))}) == 1
    assert store.vacuum(spark, path) >= 2 and store.snapshots(spark, path) == [1]
    assert {r.region_id for r in store.read(spark, path, "label_runs").collect()} == {5}


def test_annotations_are_saved_image_by_image(spark, tmp_path):
    path = str(tmp_path)
    labels_of = lambda *r: spark.createDataFrame(list(r), "image_id int, region_id int, cls int")
    runs = spark.createDataFrame([(1, 1, 0, 0, 3), (2, 1, 0, 0, 3)], RUNS)
    from rasterweir.operators.regions import region_stats

    for i in (1, 2):
        own = runs.where(F.col("image_id") == i)
        images.store_annotations(path, own, region_stats(own), labels_of((i, 1, 1)))
    images.store_annotations(path, runs.where("image_id = 2"), region_stats(runs.where("image_id = 2")), labels_of((2, 1, 0)))
    found = images.load_annotations(spark, path)
    assert rows(found[0]) == rows(runs) and rows(found[2]) == [(1, 1, 1), (2, 1, 0)] and found[1].count() == 2


def skewed(spark, n=20_000):
    u = (F.xxhash64("id") % 100_000) / 100_000.0
    return spark.range(n).select("id", (F.lit(1e9) + F.exp(12 * u)).alias("far"), F.exp(6 * u).alias("near"), F.when(F.col("id") % 3 == 0, F.lit(7.0)).alias("gaps"))


def test_merged_states_equal_one_pass(spark, tmp_path):
    data = skewed(spark)
    columns = ["far", "near", "gaps"]
    path = f"{tmp_path}/states"
    for k, share in enumerate((0.7, 0.9, 1.0)):  # batches of unlike size; one is stored twice
        low = (0, 0.7, 0.9)[k]
        batch = data.where((F.col("id") >= low * 20_000) & (F.col("id") < share * 20_000))
        for _ in range(1 + (k == 1)):
            corpus_stats.add_batch(corpus_stats.column_values(batch, columns), path, f"b{k}")
    merged = {r.metric: r for r in corpus_stats.corpus_state(spark, path).collect()}
    for c in columns:
        want = data.select(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        got = merged[c]
        assert (got.n, got.lo, got.hi) == (want.n, want.lo, want.hi)
        assert got["mean"] == pytest.approx(want["mean"], rel=1e-12) and (got.m2 / got.n) ** 0.5 == pytest.approx(want.sd, rel=1e-6, abs=1e-6)
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    exact = {c: np.sort(np.array([r[0] for r in data.select(c).where(F.col(c).isNotNull()).collect()])) for c in columns}
    for r in corpus_stats.state_quantiles(corpus_stats.corpus_state(spark, path), shares).collect():
        v = exact[r.metric]
        lo, hi = np.searchsorted(v, r.value, "left") / len(v), np.searchsorted(v, r.value, "right") / len(v)
        assert lo - 0.02 <= r.share <= hi + 0.02
    assert corpus_stats.merged_states(corpus_stats.stats_state(corpus_stats.column_values(data.limit(0), columns))).count() == 0


def test_scaler_of_states_equals_the_scaler(spark):
    data = spark.range(500).select(F.col("id").alias("key"), F.array(F.col("id") / 7.0, F.lit(3.0), F.sin("id")).alias("features"))
    parts = [corpus_stats.stats_state(corpus_stats.feature_values(data.where(F.col("key") % 3 == k))) for k in range(3)]
    got = {r.feature_idx: (r.mu, r.sigma) for r in corpus_stats.state_scaler(corpus_stats.merged_states(parts[0].union(parts[1]).union(parts[2]))).collect()}
    want = {r.feature_idx: (r.mu, r.sigma) for r in model.fit_scaler(data).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert qc.corpus_quantiles(data.select(F.col("key").cast("double").alias("v")), ["v"], (0.5,)).first().value == 249.5


def counted(monkeypatch):
    """Bytes that readers take of files, by a file system that counts."""
    read = []
    original = headers.HeaderReader._fs

    class File:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            out = self.f.read(n)
            read.append(len(out))
            return out

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, p):
            return File(self.fs.open_input_file(p))

        def get_file_info(self, x):
            return self.fs.get_file_info(x)

    monkeypatch.setattr(headers.HeaderReader, "_fs", lambda self: (Fs((w := original(self))[0]), w[1]))
    return read


def image_folder(tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    big = sinks.png(rng.integers(0, 256, (400, 500, 3)).astype(np.uint8))
    (tmp_path / "in" / "a.png").write_bytes(big)
    (tmp_path / "in" / "deep" / "a.png").write_bytes(sinks.png(np.zeros((3, 4), np.uint8)))
    (tmp_path / "in" / "b.BMP").write_bytes(b"BM" + struct.pack("<IHHI", 54 + 24, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -3, 1, 24, 0, 24, 0, 0, 0, 0) + bytes(24))
    (tmp_path / "in" / "c.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 7, 0) + struct.pack("<HHII", 257, 4, 1, 9) + bytes(4))
    (tmp_path / "in" / "d.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 5002) + bytes(5000) + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 11, 13, 3) + bytes(99))
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    (tmp_path / "in" / "cut.png").write_bytes(big[:20])
    (tmp_path / "in" / "notes.txt").write_text("text")
    return f"{tmp_path}/in", len(big)


def test_sizes_come_from_headers(spark, tmp_path):
    path, _ = image_folder(tmp_path)
    got = {r.image_id: (r.height, r.width, r.channels, r.status[:3]) for r in headers.scan_headers(spark, path, 2).collect()}
    none = (None, None, None, "bad")
    assert got == {"a.png": (400, 500, 3, "ok"), "deep/a.png": (3, 4, 1, "ok"), "b.BMP": (3, 2, 3, "ok"), "c.tif": (9, 7, 1, "ok"), "d.jpg": (11, 13, 3, "ok"), "bad.png": none, "cut.png": none}
    assert headers.scan_headers(spark, path, 2).rdd.getNumPartitions() == 4
    assert [r.image_id for r in headers.scan_headers(spark, path).where("height > 5 AND suffix = '.png'").collect()] == ["a.png"]
    assert headers.scan_headers(spark, path).where("status = 'ok' AND width < 5").count() == 2
    (tmp_path / "none").mkdir()
    assert headers.scan_headers(spark, f"{tmp_path}/none").count() == 0


def test_no_pixel_is_read_for_a_size(tmp_path, monkeypatch):
    path, size = image_folder(tmp_path)
    read = counted(monkeypatch)
    reader = headers.HeaderReader({"path": path})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 7 and size > 400_000 and sum(read) < 12_000
    read.clear()
    reader = headers.HeaderReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([EqualTo(("suffix",), ".png"), GreaterThan(("bytes",), 1000), StringContains(("image_id",), "a")]))
    assert len(left) == 1 and [r[0] for p in reader.partitions() for r in reader.read(p)] == ["a.png"] and sum(read) <= 2 * headers.READ


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    path, _ = image_folder(tmp_path)
    got = {r.image_id: (r.height, r.status) for r in images.scan_images(spark, path).collect()}
    assert got["a.png"] == (400, "ok") and got["deep/a.png"] == (3, "ok") and got["bad.png"] == (-1, "bad") and "notes.txt" not in got
    assert {r.image_id for r in images.scan_images(spark, f"file://{path}/").collect()} == set(got)


def test_an_image_of_many_regions_is_dealt_over_tasks(spark, monkeypatch):
    """Crops don't depend on parts; no task gets more than its part of the regions, or more rows of the image than they need."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (90, 70)).astype(np.uint8)
    label = np.zeros((90, 70), int)
    for k in range(200):
        y, x = rng.integers(0, 88), rng.integers(0, 66)
        label[y : y + 3, x : x + 4] = k + 1
    label[:, 69] = 500
    own = [(1, int(k), int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(label), strict=True) for k in [label[y, x]]]
    runs = images.pixel_runs(spark.createDataFrame([r[:4] for r in own], "image_id int, region_id int, y int, x int"))
    gray = spark.createDataFrame([(1, 90, 70, bytearray(a.tobytes())), (2, 5, 5, None)], "image_id int, height int, width int, data binary")
    got = []
    for part in (10_000, 7):
        monkeypatch.setattr(features, "PART_REGIONS", part)
        got.append({r.region_id: tuple(r) for r in features.region_crops(gray, runs, 3).collect()})
        parted, bands = features._parts(runs, 4)
        assert parted.select("part", "region_id").distinct().groupBy("part").count().agg(F.max("count")).first()[0] <= part
        cut = features._bands(gray, bands).select("part", "height").collect()
        assert len(cut) == -(-len(got[0]) // part)
    assert got[0] == got[1] and len(got[0]) > 100
    assert sorted(r.height for r in cut)[len(cut) // 2] < 30
    assert features.region_crops(gray, runs.withColumn("image_id", F.lit(2))).count() == 0
