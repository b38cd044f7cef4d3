"""Properties of jobs, guards, plans, and stream against batch."""

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from rasterweir.operators import features, labels, model, qc, rasters, regions
from rasterweir.plans import registry
from rasterweir.sources import fixtures, images


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def simulate(log):
    """The labelling session by stacks, action by action."""
    out, mode = {}, {}
    hist, lab = {}, {}
    for r in log.sort_values(["session_id", "seq"]).itertuples():
        s, key = r.session_id, (r.session_id, r.image_id)
        if r.action in ("mode0", "mode1"):
            mode[s] = int(r.action[-1])
        elif r.action == "click" and r.region_id > 0:
            hist.setdefault(key, []).append((r.region_id, lab.get((key, r.region_id))))
            lab[key, r.region_id] = mode.get(s, 1)
        elif r.action == "undo" and hist.get(key):
            region, before = hist[key].pop()
            if before is None:
                del lab[key, region]
            else:
                lab[key, region] = before
        elif r.action == "clear":
            hist[key] = []
            for k in [k for k in lab if k[0] == key]:
                del lab[k]
    for (key, region), c in lab.items():
        out[(*key, region)] = c
    return out


def test_replay_equals_a_stack_simulation(spark):
    rng = np.random.default_rng(1)
    n = 4000
    log = pd.DataFrame({"session_id": rng.integers(0, 25, n), "image_id": rng.integers(0, 3, n).astype(np.int32), "action": rng.choice(["click", "click", "click", "undo", "clear", "mode0", "mode1"], n, p=[0.2, 0.2, 0.2, 0.25, 0.01, 0.07, 0.07]), "region_id": rng.integers(0, 5, n).astype(np.int32)})
    log["seq"] = log.groupby("session_id").cumcount() + 1
    got = labels.annotation_replay(spark.createDataFrame(log)).collect()
    assert {(r.session_id, r.image_id, r.region_id): r.cls for r in got} == simulate(log)


def test_relabel_is_dense_and_keeps_order(spark):
    got = registry.QUERIES["relabel"](spark, DATA).toPandas()
    for _, own in got.sort_values("region_id").groupby("image_id"):
        assert own["new_id"].tolist() == list(range(1, len(own) + 1))


def test_split_is_whole_and_stable(spark):
    data = fixtures.vectors(spark, DATA).select(F.col("vec_id").alias("key"), "features", "cls")
    a = model.train_val_split(data, 0.2, 1).select("key", "part").toPandas()
    b = model.train_val_split(data.repartition(13), 0.2, 1).select("key", "part").toPandas()
    assert rows_of(a) == rows_of(b) and len(a) == data.count() and (a["part"] == "val").sum() == 100


def test_split_of_few_rows(spark):
    two = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0)], "key long, features array<double>, cls int")
    assert sorted(r.part for r in model.train_val_split(two).collect()) == ["train", "val"]
    other = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, [1.0], 1)], "key long, features array<double>, cls int")
    assert sorted(r.part for r in model.train_val_split(other).collect()) == ["both", "both", "unused"]


def test_one_class_fails(spark):
    one = spark.createDataFrame([(1, [0.0], 0)], "key long, features array<double>, cls int")
    with pytest.raises(ValueError, match="two classes"):
        model.init_prototypes(one, 2)
    with pytest.raises(ValueError, match="two classes"):
        labels.class_counts(one, check=True)


def test_nearest_prototype_equals_numpy_and_moves_nothing(spark):
    data = fixtures.vectors(spark, DATA).select(F.col("vec_id").alias("key"), "features", "cls")
    protos = registry._protos(spark, DATA)
    scored = model.nearest_prototype(data, protos)
    pdf = scored.toPandas()
    w = protos.orderBy("proto_id").toPandas()
    x, p = np.stack(pdf["features"]), np.stack(w["w"])
    assert (w["proto_id"].to_numpy()[((x[:, None] - p[None]) ** 2).sum(2).argmin(1)] == pdf["proto_id"]).all()
    assert "hashpartitioning" not in plan(scored)


def test_map_only_jobs_have_no_exchange(spark):
    gray = spark.range(3).select(F.col("id").cast("int").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.expr("cast(repeat('ab', 32) as binary)").alias("data"))
    for df in (rasters.candidate_mask(gray), rasters.connected_components(gray), qc.image_stencil_qc(gray)):
        assert "Exchange" not in plan(df)
        assert df.count() >= 0


def test_training_is_no_worse_than_its_start(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(2.5, 1, (60, 3))])
    data = spark.createDataFrame([(i, [float(v) for v in r], int(i >= 60)) for i, r in enumerate(x)], "key long, features array<double>, cls int")
    best, history = model.hlvq_fit(data, epochs=3, total=8, warmup=0, patience=5)
    h = history.orderBy("epoch").toPandas()
    score = model.accuracy(model.nearest_prototype(model.train_val_split(data).where("part <> 'train'"), best)).first()[0]
    assert score == pytest.approx(h["acc_val"].max()) and score >= h["acc_val"].iloc[0]


def test_features_of_an_absent_region_and_names(spark):
    assert len(features.FEATURES) == 30 and len(set(features.FEATURES)) == 30
    regs = spark.createDataFrame([(0, 1, 4, 0, 0, 2, 2, 0, 0)], "image_id int, region_id int, area long, x_min int, y_min int, x_max int, y_max int, cx int, cy int")
    gray = spark.createDataFrame([(0, 5, 5, bytearray(25))], "image_id int, height int, width int, data binary")
    none = spark.createDataFrame([], "image_id int, region_id int, y int, x0 int, x1 int")
    got = features.region_features(regs, gray.select("image_id", "height", "width"), gray, none).first()
    assert got["features"][:28] == [0.0] * 28


def test_checkerboard_texture(spark):
    board = bytearray(int((y + x) % 2 * 255) for y in range(8) for x in range(8))
    gray = spark.createDataFrame([(0, 8, 8, board)], "image_id int, height int, width int, data binary")
    runs = spark.createDataFrame([(0, 1, y, 0, 8) for y in range(8)], "image_id int, region_id int, y int, x0 int, x1 int")
    r = features.region_glcm(features.region_crops(gray, runs)).first()
    assert r.glcm_contrast == pytest.approx(31 * 31 / 2) and r.glcm_dissimilarity == pytest.approx(15.5)


def test_feature_plans_are_one_map(spark):
    gray = spark.createDataFrame([(0, 8, 8, bytearray(64))], "image_id int, height int, width int, data binary")
    runs = spark.createDataFrame([(0, 1, 2, 1, 5)], "image_id int, region_id int, y int, x0 int, x1 int")
    regs = regions.region_stats(runs)
    text = plan(features.region_features(regs, gray.select("image_id", "height", "width"), gray, runs))
    # bands are cut where the images lie, met by their regions, and measured in one map
    assert text.count("MapInPandas") == 2 and text.count("FlatMapCoGroupsInPandas") == 1


def test_crops_and_rings_of_touching_regions(spark):
    """Two regions side by side at the frame: each one's ring holds the other's pixels, and nothing outside the image."""
    a = np.arange(36, dtype=np.uint8).reshape(6, 6)
    gray = spark.createDataFrame([(0, 6, 6, bytearray(a.tobytes()))], "image_id int, height int, width int, data binary")
    runs = spark.createDataFrame([(0, 2, 0, 0, 1), (0, 2, 1, 0, 1), (0, 1, 0, 1, 2)], "image_id int, region_id int, y int, x0 int, x1 int")
    got = {r.region_id: r for r in features.region_crops(gray, runs, 1).collect()}
    from rasterweir.functions import kernels as K

    for region, own in ((2, {(0, 0), (1, 0)}), (1, {(0, 1)})):
        ring = {(y + dy, x + dx) for y, x in own for dy, dx in K.ellipse(9)} - own
        assert sorted(got[region].ring) == sorted(int(a[y, x]) for y, x in ring if 0 <= y < 6 and 0 <= x < 6)
    assert (got[2].height, got[2].width, list(got[2].crop)) == (3, 2, [0, 3, 6, 3, 3, 3])


def test_a_failing_image_is_alone(spark):
    """Its mask is empty and says why; the other images and the job go on, and it has no regions."""
    side = 40
    y, x = np.ogrid[:side, :side]
    good = (((y - 20) ** 2 + (x - 20) ** 2 < 80) * 200 + (y * x) % 7).astype(np.uint8)
    gray = spark.createDataFrame([(1, side, side, bytearray(good.tobytes())), (2, side, side, bytearray(good.tobytes()))], "image_id int, height int, width int, data binary")

    def breaks(a):
        if a[0, 0] == 9:
            raise KeyError("no such level")
        return a > 0

    bad = spark.createDataFrame([(1, 1, 2, bytearray(b"\x09a")), (2, 1, 2, bytearray(b"ab"))], "image_id int, height int, width int, data binary")
    got = {r.image_id: r for r in rasters.raster_map(bad, breaks).collect()}
    assert got[1].data == bytearray(2) and got[1].status.startswith("failed") and (got[2].data, got[2].status) == (bytearray(b"\1\1"), "ok")

    def fails_on_one(a, fc, area, k):
        if a[0, 0] == 0xFE:
            raise ArithmeticError("this image")
        return a > 100

    original, rasters.candidate = rasters.candidate, fails_on_one
    try:
        masked = gray.withColumn("data", F.when(F.col("image_id") == 1, F.expr("cast(concat(cast(X'FE' as binary), substring(data, 2, 1599)) as binary)")).otherwise(F.col("data")))
        runs, done, status = rasters.segment_corpus(masked, images.unpack(masked), fc=4, least=20)
        said = {r.image_id: r.status for r in status.collect()}
    finally:
        rasters.candidate = original
    assert said[1].startswith("failed") and said[2] in ("ok", "empty")
    assert {r.image_id for r in runs.collect()} <= {2} and not any(done.where("image_id = 1").first()["data"])


def test_prototypes_in_blocks_and_their_number(spark):
    """More prototypes than a block takes are scored block by block; as many as training allows at most can be drawn."""
    rng = np.random.default_rng(4)
    w = np.round(rng.normal(size=(90, 3)), 1)
    protos = spark.createDataFrame([(int(i) * 3 - 20, int(i) % 4, [float(v) for v in x]) for i, x in enumerate(w)], "proto_id int, cls int, w array<double>")
    data = spark.createDataFrame([(i, [float(v) for v in np.round(rng.normal(size=3), 1)], 0) for i in range(50)] + [(50, None, 0)], "key long, features array<double>, cls int")
    whole, cut = ({tuple(r) for r in model.nearest_prototype(data, protos, block).select("key", "proto_id", "d2", "pred").collect()} for block in (1000, 20))
    assert whole == cut and len(whole) == 51
    with pytest.raises(ValueError, match="at most"):
        model.init_prototypes(data, model.MAX_PROTOTYPES + 1)


@pytest.mark.parametrize(("size", "dim"), [(1, 2), (300, 2), (3_000, 5), (100_000, 2)])
def test_index_equals_a_plain_search(size, dim):
    from rasterweir.operators.nearest import PrototypeIndex

    rng = np.random.default_rng(size)
    w = rng.normal(size=(size, dim))
    w[size // 2 :] = np.round(w[size // 2 :], 1)  # equal ones, and ties
    x = np.concatenate([np.round(rng.normal(size=(150, dim)), 1), w[:20], rng.normal(size=(20, dim)) * 100])
    at, d2, taken = PrototypeIndex(w).search(x)
    for i, v in enumerate(x):
        plain = ((v - w) ** 2).sum(axis=1)
        assert at[i] == plain.argmin() and d2[i] == plain.min()
    if size == 100_000:
        assert taken < 0.1 * len(x) * size


def test_skipped_distances_are_reported(spark):
    data = spark.range(300).select(F.col("id").alias("key"), F.array(F.col("id") / 10.0, F.lit(0.0)).alias("features"))
    protos = spark.range(2000).select(F.array(F.col("id") / 50.0, F.lit(0.5)).alias("w"))
    r = model.skipped_distances(data, protos).first()
    assert (r.samples, r.prototypes) == (300, 2000) and 0.5 < r.skipped < 1 and r.taken == round((1 - r.skipped) * 600_000)


def test_nearest_prototype_with_nulls_ties_and_no_model(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [5.0, 5.0], 1), (3, None, 0), (4, [1.0, None], 1), (5, [0.5, 0.5], 1)]
    data = spark.createDataFrame(rows, "key long, features array<double>, cls int")
    protos = spark.createDataFrame([(7, 1, [0.0, 1.0]), (3, 0, [0.0, 1.0]), (9, 1, [4.0, 5.0])], "proto_id int, cls int, w array<double>")
    got = {r.key: (r.proto_id, r.d2, r.pred) for r in model.nearest_prototype(data, protos).collect()}
    none = (None, None, None)
    assert got == {1: (3, 0.0, 0), 2: (9, 1.0, 1), 3: none, 4: none, 5: (3, 0.5, 0)}
    assert {(r.proto_id, r.d2, r.pred) for r in model.nearest_prototype(data, protos.limit(0)).collect()} == {none}
    assert model.nearest_prototype(data.limit(0), protos).count() == 0


def test_stream_reads_any_size_and_reports_broken_files(spark, tmp_path):
    from rasterweir.sources import sinks
    from rasterweir.streaming import jobs

    rng = np.random.default_rng(0)
    (tmp_path / "in").mkdir()
    for name, shape in (("a.png", (5, 9)), ("b.PNG", (12, 4, 3))):
        (tmp_path / "in" / name).write_bytes(sinks.png(np.ascontiguousarray(rng.integers(0, 256, shape).astype(np.uint8))))
    (tmp_path / "in" / "c.jpg").write_bytes(b"no image")
    (tmp_path / "in" / "d.txt").write_bytes(b"text")
    run = lambda: jobs.stream_new_images(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    got = {r.image_id: r.noise for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"a.png", "b.PNG", "c.jpg"} and got["c.jpg"] is None and got["a.png"] > 0
    (tmp_path / "in" / "e.png").write_bytes(sinks.png(np.zeros((3, 3), np.uint8)))
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_masks_to_predictions(spark):
    """From candidate masks on: regions, predictions, and what was accepted."""
    y, x = np.ogrid[:40, :60]
    m = ((y - 15) ** 2 + (x - 15) ** 2 < 60) | ((y - 20) ** 2 + (x - 42) ** 2 < 150)
    gray = spark.createDataFrame([(1, 40, 60, bytearray((m * 150 + (y + x) % 9).astype(np.uint8).tobytes()))], "image_id int, height int, width int, data binary")
    mask = gray.withColumn("data", F.lit(bytearray(m.astype(np.uint8).tobytes())))
    scaler = spark.createDataFrame([(i, 0.0, 1.0) for i in range(30)], "feature_idx int, mu double, sigma double")
    runs = rasters.connected_components(mask)
    vec = {r.region_id: [float(v) for v in r.features] for r in features.region_features(regions.region_stats(runs), gray.select("image_id", "height", "width"), gray, runs).collect()}
    protos = spark.createDataFrame([(1, 0, vec[1]), (2, 1, vec[2])], "proto_id int, cls int, w array<double>")
    _, found, kept = rasters.classify_masks(mask, gray, scaler, protos)
    assert {r.region_id: r.cls for r in found.collect()} == {1: 0, 2: 1}
    assert regions.region_stats(kept).first()["area"] == int(m[:, 30:].sum()) and {r.region_id for r in kept.collect()} == {1}


def test_unreadable_step_is_reported(spark):
    gray = spark.createDataFrame([(i, 2, 2, bytearray(b"abcd")) for i in (1, 2, 3)], "image_id int, height int, width int, data binary")
    kind = "image_id int, steps array<struct<name: string, method: string, params: map<string, double>>>"
    steps = spark.createDataFrame([(1, [("x", "no such step", {})]), (2, [("x", "gamma", {"gamma": 1.0}), ("y", "median", {"width": 3.0})]), (3, [("x", "frequency_low_ideal", {"fc": 9.0})])], kind)
    got = {r.image_id: r for r in rasters.apply_filters(gray, steps).collect()}
    assert "unknown step" in got[1].status and got[2].status.startswith("failed: median") and got[2].data == bytearray(b"abcd") and got[3].status == "ok"
    extra = rasters.apply_filters(gray, steps, {"no such step": lambda a: a + 1}).where("image_id = 1")
    assert extra.first()["data"] == bytearray(b"bcde")


def test_empty_folder_fails(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no image"):
        images.scan_images(spark, str(tmp_path))


def test_packing_is_reversible(spark):
    p = fixtures.dense_activity(spark, DATA)
    back = images.unpack(images.pack(p, registry.H, registry.W))
    assert rows_of(p.select("image_id", "y", "x", "v").toPandas()) == rows_of(back.toPandas())


def test_runs_and_pixels(spark):
    label = registry.lab(spark, DATA)
    assert rows_of(images.run_pixels(images.pixel_runs(label)).toPandas()) == rows_of(label.toPandas())


def test_watershed_segments_lie_in_their_islands(spark):
    seg = registry.QUERIES["watershed_islands"](spark, DATA)
    label = registry.lab(spark, DATA).select("image_id", "y", "x")
    assert seg.join(label, ["image_id", "y", "x"], "left_anti").count() == 0
    assert seg.groupBy("image_id", "y", "x").count().where("count > 1").count() == 0


def test_reconnecting_merges_touching_regions(spark):
    runs = spark.createDataFrame([(0, 1, 0, 0, 2), (0, 2, 1, 2, 4)], "image_id int, region_id int, y int, x0 int, x1 int")
    merged = rasters.connected_components(images.pack(images.run_pixels(runs).withColumn("v", F.lit(1))))
    assert regions.region_stats(merged).count() == 1


# ---- failures and statuses ----------------------------------------------------------------------------------------------

BROKEN = [(1, 2, 3, b"abcdef"), (2, 2, 3, None), (3, 2, 3, b"ab"), (4, -1, -1, b""), (5, 2, 3, b"fedcba")]
PACKED = "image_id int, height int, width int, data binary"


def test_null_and_short_data_have_a_status(spark):
    gray = spark.createDataFrame([(i, h, w, None if d is None else bytearray(d)) for i, h, w, d in BROKEN], PACKED)
    got = {r.image_id: (bytes(r.data), r.status) for r in rasters.raster_map(gray, lambda a: a + 1).collect()}
    assert got[1] == (b"bcdefg", "ok") and got[5][1] == "ok"
    assert got[2] == (bytes(6), "failed: no data") and got[3] == (bytes(6), "failed: 2 bytes for 2 x 3 pixels") and got[4][0] == b"" and got[4][1].startswith("failed")
    steps = spark.createDataFrame([(1, [("x", "gamma", {"gamma": 1.0})]), (2, [("x", "gamma", {"gamma": 1.0})]), (3, None)], "image_id int, steps array<struct<name: string, method: string, params: map<string, double>>>")
    done = {r.image_id: (bytes(r.data), r.status) for r in rasters.apply_filters(gray, steps).collect()}
    assert set(done) == {1, 2, 3, 4, 5} and done[5] == (b"fedcba", "ok") and done[1][1] == "ok" and all(done[i][1].startswith("failed") for i in (2, 3, 4))
    assert {r.image_id for r in rasters.connected_components(gray).collect()} == {1, 5}
    assert rasters.watershed_islands(gray, gray, least=1).where("image_id IN (2, 3, 4)").count() == 0
    runs, _ = rasters.watershed_mask(gray, gray)
    assert runs.where("image_id IN (2, 3, 4)").count() == 0
    from rasterweir.operators import qc

    assert {r.image_id: r.noise is None for r in qc.image_stencil_qc(gray).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_every_image_of_a_segmentation_has_a_true_status(spark):
    y, x = np.ogrid[:40, :40]
    good = (((y - 20) ** 2 + (x - 20) ** 2 < 80) * 200 + (y * x) % 7).astype(np.uint8).tobytes()
    rows = [(1, 40, 40, bytearray(good)), (2, 40, 40, bytearray(good)), (3, 40, 40, None), (4, 40, 40, bytearray(good[:-1])), (5, 40, 40, bytearray(1600))]
    gray = spark.createDataFrame(rows, PACKED)
    pixels = images.unpack(gray.where("image_id IN (1, 5)")).union(images.unpack(gray.where("image_id = 1")).select(F.lit(4), "y", "x", "v"))
    runs, _, status = rasters.segment_corpus(gray, pixels, fc=4, least=20)
    said = {r.image_id: r.status for r in status.collect()}
    assert said[1] == "ok" and said[2] == "failed: no pixels" and said[3] == "failed: no data" and said[4].startswith("failed: 1599 bytes") and said[5] == "empty"
    assert {r.image_id for r in runs.collect()} == {1}
