"""Exact sequential training against a plain loop over samples."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweir.operators import model, sequential


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def u(*parts):
    return int(md5(*parts)[:12], 16) / 2**48


def gauss(a, b):
    return math.sqrt(-2 * math.log(1 - a)) * math.cos(2 * math.pi * b)


def plain(rows, seed, total, epochs, alpha0, patience, warmup, p_drop, p_jump, buckets=None, alpha_min=0.001):
    """One sample after the other, distances by loops; ``buckets``: key -> bucket."""
    rows = sorted(rows)
    by_hash = sorted(rows, key=lambda r: md5(seed, r[0])[:16])
    n_val = max(1, min(len(rows) - 1, round(len(rows) * 0.2)))
    val_keys = {r[0] for r in by_hash[:n_val]}
    train, val = [r for r in rows if r[0] not in val_keys], [r for r in rows if r[0] in val_keys]
    if {r[2] for r in rows} - {r[2] for r in val}:
        val = train
    classes = sorted({r[2] for r in train})
    lo, hi, sd, size = {}, {}, {}, {}
    for c in classes:
        own = np.array([r[1] for r in train if r[2] == c])
        lo[c], hi[c], sd[c], size[c] = own.min(0), own.max(0), own.std(0), len(own)
        sd[c] = np.where(sd[c] < 1e-6, 0.01, sd[c])
    w, of = [], []
    for k, c in enumerate(classes):
        want = total // len(classes) + (k < total % len(classes))
        own = [r for r in by_hash if r in train and r[2] == c][:want]
        for slot in range(want):
            p, v = len(w), np.array(own[slot % len(own)][1])
            jitter = np.array([gauss(u(seed, "u", p, f), u(seed, "v", p, f)) for f in range(len(v))])
            w.append(np.clip(v + 0.05 * sd[c] * jitter, lo[c], hi[c]))
            of.append(c)

    def dist(x, v):
        return float(sum((a - b) ** 2 for a, b in zip(x, v, strict=True)))

    def accuracy(part):
        return sum(of[min(range(len(w)), key=lambda g: (dist(x, w[g]), g))] == c for _, x, c in part) / len(part)

    history = [(-1, accuracy(train), accuracy(val))]
    best, bad = history[0], 0
    for t in range(epochs):
        s = t / epochs
        alpha = alpha0 * (1 - s) ** 2
        if s < 0.7 and u(seed, "j", t) < p_jump:
            n1, n2 = gauss(u(seed, "a", t), u(seed, "b", t)), gauss(u(seed, "c", t), u(seed, "d", t))
            scale = (math.gamma(2.5) * math.sin(math.pi * 0.75) / (math.gamma(1.25) * 1.5 * 2**0.25)) ** (1 / 1.5)
            alpha *= 1 + 0.08 * abs(scale * n1 / max(abs(n2), 1e-12) ** (1 / 1.5))
        alpha = max(alpha_min, min(alpha, alpha0))
        on = set(range(len(w)))
        if warmup <= t < epochs / 2:
            on = {g for g in on if u(seed, "drop", t, g) >= p_drop}
            for c in classes:
                on.add(max((g for g in range(len(w)) if of[g] == c), key=lambda g: (u(seed, "drop", t, g), -g)))
        order = sorted(train, key=lambda r: md5(seed, t, r[0])[:16])
        if buckets:
            order = sorted(order, key=lambda r: md5(seed, t, f"b{buckets[r[0]]}")[:16])
        kept = {}
        for key, x, c in order:
            g = min(on, key=lambda g: (dist(x, w[g]), g))
            if of[g] == c:
                kept.setdefault(g, []).append((key, x))
            else:
                w[g] = w[g] - 0.25 * alpha * (np.array(x) - w[g])
        after = []
        for g in range(len(w)):
            if g in kept:
                near = sorted(kept[g], key=lambda r: (dist(r[1], w[g]), r[0]))[:7]
                after.append(w[g] + alpha * (np.mean([x for _, x in near], axis=0) - w[g]))
            elif size[of[g]] >= 2 and (hi[of[g]] > lo[of[g]]).all():
                after.append(lo[of[g]] + (hi[of[g]] - lo[of[g]]) * np.array([u(seed, "box", t, g, f) for f in range(len(w[g]))]))
            else:
                lone = min((r for r in train if r[2] == of[g]), key=lambda r: md5(seed, t, r[0])[:16])
                after.append(np.array(lone[1]) + 0.08 * np.array([gauss(u(seed, "n1", t, g, f), u(seed, "n2", t, g, f)) for f in range(len(w[g]))]))
        w = after
        history.append((t, accuracy(train), accuracy(val)))
        if history[-1][2] > best[2]:
            best, bad = history[-1], 0
        else:
            bad += 1
            if bad >= patience:
                break
    return best, len(history) - 1


def samples(n, seed, classes=2):
    rng = np.random.default_rng(seed)
    return [(int(k) * 7, [float(v) for v in rng.normal(size=3) + (k % classes) * 0.7], int(k % classes)) for k in range(n)]


SETTINGS = "config_id int, seed int, total int, epochs int, alpha0 double, patience int, warmup int, p_drop double, p_jump double"


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, features array<double>, cls int")


@pytest.mark.parametrize("bucket_rows", [50_000, 25])
def test_training_equals_a_plain_loop(spark, bucket_rows):
    rows = samples(90, 1, 3) + [(5000, [9.0, 9.0, 9.0], 7), (5001, [9.0, 9.0, 9.0], 7), (5002, [9.0, 9.0, 9.0], 7)]  # a class without a range
    settings = [(1, 11, 13, 14, 0.3, 30, 2, 0.4, 0.5), (2, 12, 9, 12, 0.2, 3, 20, 0.0, 0.0), (3, 5, 4, 6, 0.3, 30, 0, 0.9, 1.0)]
    data = frame(spark, rows)
    n = -(-len(rows) // bucket_rows)
    buckets = {r.key: r.b for r in data.select("key", F.pmod(F.xxhash64("key"), F.lit(n)).alias("b")).collect()}
    got = {r.config_id: r for r in sequential.hlvq_sweep(data.repartition(4), spark.createDataFrame(settings, SETTINGS), bucket_rows).collect()}
    for c, *rest in settings:
        best, epochs_run = plain(rows, *rest, buckets=buckets if n > 1 else None)
        assert (got[c].best_epoch, got[c].epochs_run) == (best[0], epochs_run)
        assert (got[c].acc_train, got[c].acc_val) == pytest.approx(best[1:])
        assert len(got[c].prototypes) == rest[1]
    assert got[2].epochs_run < 12  # patience


def test_draws_are_those_of_the_relations(spark):
    """Schedule and dropout are the same numbers as the DataFrame operators'."""
    c = sequential.DEFAULTS | {"seed": 3, "epochs": 40}
    want = [r.alpha for r in model.levy_alpha(spark, 40, 0.03, 0.001, seed=3).orderBy("epoch").collect()]
    assert [sequential.alpha_at(t, c) for t in range(40)] == pytest.approx(want)
    protos = spark.createDataFrame([(i, i % 2, [0.0]) for i in range(30)], "proto_id int, cls int, w array<double>")
    want = [r.active for r in model.dropout_mask(protos, 12, 40, 0.15, 10, 3).orderBy("proto_id").collect()]
    assert sequential._active(np.arange(30) % 2, 12, c).tolist() == want and not all(want)


def test_any_number_of_rows_and_bad_ones(spark):
    rows = spark.range(60_001).select(F.col("id").alias("key"), F.array((F.col("id") % 2).cast("double"), F.col("id") / 60_001).alias("features"), (F.col("id") % 2).cast("int").alias("cls"))
    rows = rows.union(spark.createDataFrame([(None, [1.0, 1.0], 1), (-1, None, 1), (-2, [1.0, None], 1), (-3, [1.0, 1.0], None)], "key long, features array<double>, cls int"))
    got = sequential.hlvq_sweep(rows, spark.createDataFrame([(3, 5, 4, 2)], "config_id int, seed int, total int, epochs int")).collect()
    assert [(r.config_id, r.acc_val) for r in got] == [(3, 1.0)]
    with pytest.raises(Exception, match="two classes"):
        sequential.hlvq_sweep(rows.where("cls = 1"), spark.createDataFrame([(3, 5)], "config_id int, seed int")).collect()


def test_sweep_query_has_every_label_and_its_settings_act(spark):
    from conftest import DATA

    from rasterweir.plans import registry

    got = registry.QUERIES["hlvq_sweep"](spark, DATA).collect()
    assert {r.config_id for r in got} == {r.label for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("label").distinct().collect()}
    assert all(30 <= r.epochs_run < 300 and r.epochs_run == r.best_epoch + 31 for r in got)  # past warm-up, ended by patience


def test_winners_by_products_are_those_by_differences():
    """Equal and nearly equal prototypes, far ones and values that products can't tell apart; the work is products, not differences."""
    rng = np.random.default_rng(2)
    w = rng.normal(size=(40, 6))
    w[7], w[9], w[11] = w[3], w[3] + 1e-15, w[4] * (1 + 1e-15)
    x = np.concatenate([rng.normal(size=(3000, 6)), w, (w[3] + w[5])[None] / 2])
    for far in (0.0, 1e6, 1e9):
        assert (sequential._nearest(x + far, w + far) == ((x[:, None] + far - (w + far)[None]) ** 2).sum(-1).argmin(1)).all()


def test_few_differences_are_taken(monkeypatch, tmp_path):
    """Training compares by squared differences only where products leave several prototypes within rounding."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows, taken, plain_apart = samples(400, 3), [], sequential._apart
    (tmp_path / "bucket=0").mkdir()
    pq.write_table(pa.table({"key": [r[0] for r in rows], "features": [r[1] for r in rows], "cls": pa.array([r[2] for r in rows], pa.int32())}), tmp_path / "bucket=0" / "a.parquet")
    monkeypatch.setattr(sequential, "_apart", lambda x, w: (taken.append(len(x)), plain_apart(x, w))[1])
    got = sequential.train(str(tmp_path), {"seed": 3, "total": 20, "epochs": 5})
    assert got["epochs_run"] == 5 and sum(taken) < 400


def test_settings_have_tasks_of_their_own(spark):
    """Ten settings go to ten tasks, not by hash to fewer of them."""
    data = frame(spark, samples(60, 5))
    settings = spark.range(10).select(F.col("id").cast("int").alias("config_id"), F.lit(1).alias("seed"), F.lit(4).alias("total"), F.lit(1).alias("epochs"))
    got = sequential.hlvq_sweep(data, settings)
    assert got.count() == 10 and got.select(F.input_file_name()).distinct().count() == 10
