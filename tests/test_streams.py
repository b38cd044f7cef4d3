"""Streams: actions in any order, late ones, repeated batches."""

import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rasterweir.operators import labels, rasters, regions
from rasterweir.plans import registry
from rasterweir.sources import fixtures, images, sinks
from rasterweir.streaming import annotations, jobs

LOG = "session_id long, seq long, image_id int, action string, region_id int"


def streamed(spark, folder, batches, **options):
    """Changes of the log's batches, one micro-batch each."""
    folder.mkdir()
    schema = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        schema = spark.read.parquet(f"{folder}/in").schema
        annotations.stream_annotations(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/state", **options).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def replayed(spark, rows):
    return {tuple(r) for r in labels.annotation_replay(spark.createDataFrame(rows, LOG)).select("session_id", "image_id", "region_id", "cls").collect()}


def final(changes):
    return {tuple(r) for r in annotations.final_labels(changes).select("session_id", "image_id", "region_id", "cls").collect()}


def log_of(seed, sessions=6, n=40):
    rng = random.Random(seed)
    return [(s, k, rng.randrange(2), rng.choice(["click"] * 6 + ["undo"] * 3 + ["clear", "mode0", "mode1", "zoom"]), rng.randrange(5)) for s in range(sessions) for k in range(1, n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_equals_the_replay(spark, tmp_path, seed):
    rows = log_of(seed)
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    cut = [mixed[k::4] for k in range(4)]
    got = streamed(spark, tmp_path / "a", [*cut, cut[0]])  # the last batch repeats the first
    assert final(got) == replayed(spark, rows) and got.where("late").count() == 0


def test_an_earlier_action_that_arrives_later(spark, tmp_path):
    got = streamed(spark, tmp_path / "a", [[(1, 2, 0, "undo", 0)], [(1, 1, 0, "click", 3)]])
    assert final(got) == set() == replayed(spark, [(1, 1, 0, "click", 3), (1, 2, 0, "undo", 0)])


def test_settled_actions_are_forgotten_and_late_ones_reported(spark, tmp_path):
    rows = log_of(3, 3, 60)
    ordered = sorted(rows, key=lambda r: r[1])
    shuffled = [r for k in range(0, len(ordered), 15) for r in random.Random(k).sample(ordered[k : k + 15], len(ordered[k : k + 15]))]
    got = streamed(spark, tmp_path / "a", [shuffled[k : k + 60] for k in range(0, len(shuffled), 60)] + [[(0, 2, 1, "click", 4)]], lateness=8)
    assert final(got) == replayed(spark, rows)
    assert [(r.session_id, r.image_id, r.region_id) for r in got.where("late").collect()] == [(0, 1, 4)]


def test_state_is_bounded_by_lateness():
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    p = annotations.Annotations(10, None)
    p.state = Value()
    for k in range(30):
        pdf = pd.DataFrame([(1, 20 * k + i, 0, "click", i % 3 + 1) for i in range(20)], columns=["session_id", "seq", "image_id", "action", "region_id"])
        list(p.handleInputRows((1,), iter([pdf]), None))
        assert len(p.state.held[6]) == 4 * 10  # held actions


def test_ttl_starts(spark, tmp_path):
    got = streamed(spark, tmp_path / "a", [[(1, 1, 0, "click", 3)]], ttl_ms=3_600_000)
    assert final(got) == {(1, 0, 3, 1)}


def test_registered_stream_equals_the_replay_of_the_fixture(spark):
    want = labels.annotation_replay(fixtures.annotation_log(spark, DATA))
    got = registry.QUERIES["stream_annotations"](spark, DATA)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def arrivals(spark, tmp_path):
    gray = registry.packed(spark, DATA)
    sinks.write_png(gray, f"file://{tmp_path}/in")
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    return gray


def test_segments_of_a_stream_equal_the_batch_job(spark, tmp_path):
    gray = arrivals(spark, tmp_path)
    run = lambda: jobs.stream_segments(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", 2, fc=4, least=20).awaitTermination()
    run()
    runs, _, status = rasters.segment_corpus(gray, images.unpack(gray), fc=4, least=20)
    got = jobs.read_segments(spark, f"{tmp_path}/out")
    name = F.split("image_id", "\\.")[0].try_cast("int")
    assert {(r.i, r.status) for r in got["status"].select(name.alias("i"), "status").collect() if r.i is not None} == {(r.image_id, r.status) for r in status.collect()}
    assert [r.status for r in got["status"].where("image_id = 'bad.png'").collect()] == ["failed: unreadable"]
    own = got["label_runs"].select(name.alias("image_id"), "region_id", "y", "x0", "x1")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, runs.select(own.columns).collect()))
    assert got["regions"].count() == regions.region_stats(runs).count() and got["quality"].count() == gray.count() + 1
    before = got["label_runs"].count()
    (tmp_path / "in" / "late.png").write_bytes(sinks.png(np.zeros((30, 24), np.uint8)))
    run()
    got = jobs.read_segments(spark, f"{tmp_path}/out")
    assert got["label_runs"].count() == before and [r.status for r in got["status"].where("image_id = 'late.png'").collect()] == ["empty"]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    arrivals(spark, tmp_path)
    files = spark.read.format("image").option("dropInvalid", False).load(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    with pytest.raises(ValueError, match="no finished batch"):
        jobs.read_segments(spark, out)
    jobs.segment_batch(files, 0, f"{tmp_path}/in", out, fc=4, least=20)
    counts = {k: v.count() for k, v in jobs.read_segments(spark, out).items()}
    jobs.segment_batch(files, 0, f"{tmp_path}/in", out, fc=4, least=20)  # finished: left alone
    files.select("image.height").limit(1).write.parquet(f"{out}/quality/batch=1")  # a batch that broke off before its log entry
    assert {k: v.count() for k, v in jobs.read_segments(spark, out).items()} == counts
    jobs.segment_batch(files.limit(1), 1, f"{tmp_path}/in", out, fc=4, least=20)
    again = jobs.read_segments(spark, out)
    assert again["quality"].count() == counts["quality"] + 1 and again["status"].count() == counts["status"] + 1
