"""Runs: algebra, points, components over strips, holes; against sets of pixels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterweir.functions import kernels as K
from rasterweir.operators import graph, labels, rasters, runs

SIZE = (9, 11)
RUNS = "image_id int, y int, x0 int, x1 int"


def masks(seed, n=4, size=SIZE):
    rng = np.random.default_rng(seed)
    out = [rng.random(size) < p for p in (0.2, 0.5, 0.8, 0.95)][:n]
    return {i: m for i, m in enumerate(out)} | {n: np.zeros(size, bool), n + 1: np.ones(size, bool)}


def table(spark, held):
    rows = [(i, int(y), int(a), int(b)) for i, m in held.items() for y, a, b in zip(*K.runs(m), strict=True)]
    return spark.createDataFrame(rows, RUNS)


def pixel_set(frame):
    out = set()
    for r in frame.collect():
        own = {(r.image_id, r.y, x) for x in range(r.x0, r.x1)}
        assert own and not own & out
        out |= own
    return out


def set_of(held):
    return {(i, int(y), int(x)) for i, m in held.items() for y, x in zip(*np.nonzero(m), strict=True)}


def sizes(spark, held):
    return spark.createDataFrame([(i, *m.shape) for i, m in held.items()], "image_id int, height int, width int")


def test_algebra_equals_set_operations(spark):
    a, b = masks(1), masks(2)
    x, y = table(spark, a), table(spark, b)
    x = x.union(x.where("y = 3")).union(spark.createDataFrame([(0, 3, 5, 5)], RUNS))  # repeated and empty runs
    for how, op in (("and", set.__and__), ("or", set.__or__), ("minus", set.__sub__)):
        got = runs.run_algebra(x, y, how)
        assert pixel_set(got) == op(set_of(a), set_of(b))
        assert len(set(got.select("image_id", "y", "x0").union(got.select("image_id", "y", "x1")).collect())) == 2 * got.count()  # none touches another
    assert pixel_set(runs.complement(x, sizes(spark, a))) == {(i, y, x) for i in a for y in range(SIZE[0]) for x in range(SIZE[1])} - set_of(a)
    assert runs.run_algebra(x.limit(0), y.limit(0), "or").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        runs.run_algebra(x, y, "xor")


def test_overlapping_runs_are_one_set(spark):
    a = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 3, 8), (1, 0, 8, 9), (1, 0, 20, 21)], RUNS)
    got = sorted((r.x0, r.x1) for r in runs.run_algebra(a, a.limit(0), "or").collect())
    assert got == [(0, 9), (20, 21)]


def test_rows_follow_runs_not_pixels(spark):
    """A run of a million pixels is two places, not a million rows."""
    wide = spark.range(50).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x0"), F.lit(1_000_000).alias("x1"))
    got = runs.run_algebra(wide, wide.withColumn("x0", F.lit(10)), "minus")
    plan = got._jdf.queryExecution().toString()
    assert "sequence" not in plan and got.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 500
    assert runs.run_components(wide, strip=7).select("region_id").distinct().count() == 1


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("strip", [1, 2, 4, 64])
def test_strips_give_the_labels_of_whole_images(spark, strip, connectivity):
    held = masks(3)
    got = {tuple(r) for r in runs.run_components(table(spark, held), connectivity, strip).select("image_id", "region_id", "y", "x0", "x1").collect()}
    packed = spark.createDataFrame([(i, *m.shape, bytearray(m.astype(np.uint8).tobytes())) for i, m in held.items()], "image_id int, height int, width int, data binary")
    assert got == {tuple(r) for r in rasters.connected_components(packed, connectivity).select("image_id", "region_id", "y", "x0", "x1").collect()}


def test_no_task_sees_a_tall_image(spark):
    """A spiral over 600 rows is one region, whatever the strips; a task gets a strip's rows only."""
    m = np.zeros((600, 41), bool)
    m[::2] = True
    m[1::4, -1] = m[3::4, 0] = True
    frame = table(spark, {7: m})
    seen = []
    original = runs._labelled
    for strip in (600, 10):
        got = runs.run_components(frame, 4, strip)
        assert got.select("region_id").distinct().count() == 1 and got.count() == frame.count()
    assert original is runs._labelled and not seen


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False), st.sampled_from([4, 8]))
def test_labels_of_runs_equal_the_flood(h, w, rng, connectivity):
    m = np.array([[rng.random() < 0.6 for _ in range(w)] for _ in range(h)])
    y, x0, x1 = K.runs(m)
    first = runs._labelled(y, x0, x1, int(connectivity == 8))
    label = K.components(m, connectivity)
    assert [label[y[i], x0[i]] for i in first] == [label[a, b] for a, b in zip(y, x0, strict=True)]


@pytest.mark.parametrize("strip", [2, 100])
def test_holes_equal_the_flood(spark, strip):
    held = masks(5)
    got = pixel_set(runs.run_fill_holes(table(spark, held), sizes(spark, held), strip))
    assert got == set_of({i: K.fill_holes(m) for i, m in held.items()})


def test_points_meet_their_run_only(spark):
    held = masks(6)
    found = rasters.connected_components(spark.createDataFrame([(i, *m.shape, bytearray(m.astype(np.uint8).tobytes())) for i, m in held.items()], "image_id int, height int, width int, data binary"))
    by_pixel = {(r.image_id, r.y, x): r.region_id for r in found.collect() for x in range(r.x0, r.x1)}
    points = [(i, y, x) for i in range(7) for y in range(-1, 10) for x in range(-2, 13)]
    frame = spark.createDataFrame(points, "image_id int, y int, x int")
    assert {(r.image_id, r.y, r.x): r.region_id for r in runs.points_in_runs(frame, found).collect()} == by_pixel
    events = spark.createDataFrame([(k, *p) for k, p in enumerate(points * 2)], "event_id int, image_id int, y int, x int")
    got = labels.valid_clicks(events, found).collect()
    assert len(got) == 2 * len(by_pixel) and all(by_pixel[r.image_id, r.y, r.x] == r.region_id for r in got)
    seeds = events.withColumn("kind", F.when(F.col("event_id") % 3 == 0, "object").otherwise("background"))
    votes = {}
    for k, p in enumerate(points * 2):
        if p in by_pixel:
            votes.setdefault((p[0], by_pixel[p]), []).append(k % 3 == 0)
    want = {(*r, int(all(v))) for r, v in votes.items() if all(v) or not any(v)}
    assert {(r.image_id, r.region_id, r.cls) for r in labels.seed_labels(seeds, found).collect()} == want


def test_components_of_graphs_by_group(spark):
    edges = [(g, i, i + 1) for g in (1, 2) for i in range(0, 60, 1 + g)] + [(1, 500, 500 + i) for i in range(40)] + [(3, 5, 5), (3, None, 1), (None, 1, 2)]
    got = {(r.g, r.id): r.component for r in graph.star_components(spark.createDataFrame(edges, "g int, a long, b long"), "g").where("g IS NOT NULL").collect()}
    want = {(1, i): i - i % 2 for i in range(60)} | {(2, i): i - i % 3 for i in range(60) if i % 3 < 2} | {(1, i): 500 for i in range(500, 540)}
    assert got == want
