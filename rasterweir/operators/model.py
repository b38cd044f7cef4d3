"""Prototype classifier: scaling, splits, prototypes, epochs, fitting, scoring.

Samples are rows ``(key LONG, features ARRAY<DOUBLE>, cls INT)``, prototypes ``(proto_id INT, cls INT, w ARRAY<DOUBLE>)``.
A model in training is a few hundred short rows: they are collected per epoch, checked against MAX_PROTOTYPES, and travel
with the tasks; scoring takes any number of prototypes. Random draws come from hashes of (seed, epoch, id), not from the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import dropped, saved
from .nearest import PrototypeIndex

#: Prototypes of a model in training.
MAX_PROTOTYPES = 10_000
#: Prototypes that travel with a task at a time.
BLOCK_PROTOTYPES = 100_000
#: Deviation of the noise on a sample that becomes a prototype.
NOISE = 0.08


def uniform(*parts: Column | str | float) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons; the same in any SQL engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


# ---- scaling and splits -------------------------------------------------------------------------------------------------


def fit_scaler(data: DataFrame) -> DataFrame:
    """``(feature_idx, mu, sigma)``: mean and population deviation; a deviation under 1e-8 becomes 1."""
    long = data.select(F.posexplode("features").alias("feature_idx", "v"))
    s = long.groupBy("feature_idx").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))
    return s.withColumn("sigma", F.when(F.col("sigma") < 1e-8, 1.0).otherwise(F.col("sigma")))


def apply_scaler(data: DataFrame, scaler: DataFrame) -> DataFrame:
    """``(x - mu) / sigma`` per feature; the scaler has a row per feature and is broadcast as two arrays."""
    row = scaler.agg(F.sort_array(F.collect_list(F.struct("feature_idx", "mu", "sigma"))).alias("_s"))
    wide = data.crossJoin(F.broadcast(row))  # one row on the right
    return wide.withColumn("features", F.zip_with("features", "_s", lambda x, s: (x - s["mu"]) / s["sigma"])).drop("_s")


def train_val_split(data: DataFrame, share: float = 0.2, seed: int = 0, *, exact: bool = True) -> DataFrame:
    """``data`` with ``part`` (``train`` or ``val``): rows in order of md5(seed:key), the first n_val validate.

    n_val = max(1, min(N - 1, bround(N * share))). exact: the cut is the n_val-th hash; else a
    threshold on the hash, for corpora where even that is too much. A class missing from validation: the training rows also
    validate, as part ``both``, and the others are ``unused``.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")))
    data = data.withColumn("_h", h)
    if exact:
        n = data.count()
        n_val = max(1, min(n - 1, int(round(n * share))))
        # the hash prefix in which the n_val-th row lies, from 65,536 counts at most; only that prefix's rows are ordered
        upto = F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
        steps = data.groupBy(F.substring("_h", 1, 4).alias("p")).count().withColumn("upto", upto)
        at = steps.where(F.col("upto") >= n_val).orderBy("p").first() or {"p": "", "upto": 0, "count": 0}
        rest = n_val - (at["upto"] - at["count"])
        cut = data.where(F.substring("_h", 1, 4) == at["p"]).select("_h").orderBy("_h").limit(rest).agg(F.max("_h").alias("_cut"))
        out = data.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col("_h") <= F.col("_cut"), "val").otherwise("train")).drop("_h", "_cut")
    else:
        out = data.withColumn("part", F.when(uniform(seed, F.col("key")) < share, "val").otherwise("train")).drop("_h")
    classes = out.groupBy("cls").agg(F.max((F.col("part") == "val").cast("int")).alias("seen"))
    lacks = classes.where("seen = 0").count() > 0
    return out.withColumn("part", F.when(F.col("part") == "val", "unused").otherwise("both")) if lacks else out


def class_ranges(data: DataFrame) -> DataFrame:
    """``(cls, feature_idx, lo, hi, sd)``; a deviation under 1e-6 becomes 0.01."""
    long = data.select("cls", F.posexplode("features").alias("feature_idx", "v"))
    s = long.groupBy("cls", "feature_idx").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("sd"))
    return s.withColumn("sd", F.when(F.col("sd") < 1e-6, 0.01).otherwise(F.col("sd")))


def init_prototypes(data: DataFrame, total: int = 200, seed: int = 0, noise: float = 0.05) -> DataFrame:
    """``total`` prototypes spread over the classes, drawn from their samples by hash order, jittered and clipped to the class range.

    The remainder goes to the first classes; a class with fewer samples gives them again in turn. One class raises.
    Before ranking, samples are cut by a hash threshold to a few times what is needed, so no class is sorted whole.
    """
    if total > MAX_PROTOTYPES:
        raise ValueError(f"{total} prototypes; {MAX_PROTOTYPES} at most")
    sizes = {r["cls"]: r["n"] for r in data.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # a row per class
    if len(sizes) < 2:
        raise ValueError("two classes are needed at least")
    base, rest = divmod(total, len(sizes))
    plan = data.sparkSession.createDataFrame([(c, sizes[c], base + (i < rest)) for i, c in enumerate(sorted(sizes))], "cls int, size long, want int")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))), "key")) - 1
    near = data.join(F.broadcast(plan), "cls").where(uniform(seed, F.col("key")) <= 4.0 * (F.col("want") + 16) / F.col("size"))
    near = data.join(F.broadcast(plan), "cls") if all(sizes[c] <= 4 * (base + 17) for c in sizes) else near
    picked = near.withColumn("k", rank).where("k < least(want, size)")
    slots = plan.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("want") - 1))).where("want > 0").withColumn("k", F.col("slot") % F.least("want", "size"))
    got = slots.join(picked.select("cls", "k", "features"), ["cls", "k"])
    proto = F.row_number().over(Window.orderBy("cls", "slot")) - 1  # ``total`` rows
    got = got.withColumn("proto_id", proto).select("proto_id", "cls", F.posexplode("features").alias("feature_idx", "v"))
    # a normal number from two uniform ones
    u1, u2 = uniform(seed, "u", F.col("proto_id"), F.col("feature_idx")), uniform(seed, "v", F.col("proto_id"), F.col("feature_idx"))
    normal = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)
    v = F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("v") + noise * F.col("sd") * normal)) if noise else F.col("v")
    out = got.join(class_ranges(data), ["cls", "feature_idx"]).withColumn("v", v)
    return out.groupBy("proto_id", "cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature_idx", "v"))), lambda s: s["v"]).alias("w"))


# ---- scoring ------------------------------------------------------------------------------------------------------------


def _scored(data: DataFrame, model: pa.Table, kinds: dict[str, str], so_far: str | None) -> DataFrame:
    """``data`` with ``_b`` struct<d2, proto_id, cls>: the nearest of the model's prototypes, or what is so far if that is as near."""
    ids, classes = model.column("proto_id").to_pylist(), model.column("cls").to_pylist()
    w = np.array(model.column("w").to_pylist(), float) if len(ids) else np.zeros((0, 0))
    shared = data.sparkSession.sparkContext.broadcast((ids, classes, PrototypeIndex(w) if len(ids) else None))  # BLOCK_PROTOTYPES at most

    def scored(features: pd.Series) -> pd.DataFrame:
        ids, classes, index = shared.value
        good = np.array([index is not None and f is not None and not np.isnan(np.asarray(f, float)).any() for f in features], bool)
        at, d2, rows = np.zeros(len(features), np.int64), np.full(len(features), np.nan), np.flatnonzero(good)
        if len(rows):
            at[rows], d2[rows], _ = index.search(np.stack(features.iloc[rows].to_list()).astype(float))
        pick = lambda v: pd.Series(np.asarray(v)[at] if good.all() and len(v) else [v[k] if g else None for k, g in zip(at.tolist(), good.tolist(), strict=True)], dtype=None if good.all() else object)
        return pd.DataFrame({"d2": pd.Series(d2) if good.all() else pd.Series(d2).astype(object).where(good, None), "proto_id": pick(ids), "cls": pick(classes)})

    best = F.pandas_udf(scored, f"d2 double, proto_id {kinds['proto_id']}, cls {kinds['cls']}")("features")
    if so_far is None:
        return data.withColumn("_b", best)
    out = data.withColumn("_n", best)
    older = F.col(so_far).isNotNull() & ((F.col(f"{so_far}.d2") < F.col("_n.d2")) | ((F.col(f"{so_far}.d2") == F.col("_n.d2")) & (F.col(f"{so_far}.proto_id") < F.col("_n.proto_id"))))
    return out.withColumn(so_far, F.when(older, F.col(so_far)).otherwise(F.col("_n"))).drop("_n")


def nearest_prototype(data: DataFrame, prototypes: DataFrame, block: int = BLOCK_PROTOTYPES) -> DataFrame:
    """``data`` with ``proto_id``, ``d2`` and ``pred``: the prototype at least squared distance, ties to the lowest id.

    Map-only. Up to ``block`` prototypes travel with the tasks, in an index that skips groups of prototypes by the triangle inequality. More of them
    are dealt to blocks that the data passes one after the other with the nearest one so far, so their number has no limit; the
    data is written between blocks. Features that are null or hold a null or NaN, and a model without prototypes, give nulls.
    """
    kinds = {f.name: f.dataType.simpleString() for f in prototypes.schema.fields}
    model = prototypes.select("proto_id", "cls", "w").orderBy("proto_id").limit(block + 1).toArrow()
    if model.num_rows <= block:
        out = _scored(data, model, kinds, None)
    else:
        held = saved(prototypes.select("proto_id", "cls", "w"), "prototypes")
        blocks = math.ceil(1.25 * held.count() / block)  # hashed blocks are uneven
        out = data
        for k in range(blocks):
            own = held.where(F.pmod(F.xxhash64("proto_id"), F.lit(blocks)) == k).orderBy("proto_id").toArrow()
            out = saved(_scored(out, own, kinds, "_b" if k else None), "nearest")
        dropped(held)
    return out.select(*[F.col(f"`{c}`") for c in data.columns], F.col("_b.proto_id").alias("proto_id"), F.col("_b.d2").alias("d2"), F.col("_b.cls").alias("pred"))


def skipped_distances(data: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``(samples, prototypes, taken, skipped)``: distances that the index takes for ``data``, and the share it skips. BLOCK_PROTOTYPES at most."""
    w = prototypes.select("w").limit(BLOCK_PROTOTYPES).toArrow().column("w").to_pylist()
    shared = data.sparkSession.sparkContext.broadcast(PrototypeIndex(np.array(w, float)))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"samples": [len(pdf)], "taken": [shared.value.search(np.stack(pdf["features"].to_list()).astype(float))[2] if len(pdf) else 0]})

    sums = data.where("features IS NOT NULL").select("features").mapInPandas(count, "samples long, taken long").agg(F.sum("samples").alias("samples"), F.sum("taken").alias("taken"))
    return sums.select("samples", F.lit(len(w)).cast("long").alias("prototypes"), "taken", (1 - F.col("taken") / (F.col("samples") * len(w))).alias("skipped"))


def accuracy(scored: DataFrame) -> DataFrame:
    """``accuracy``: share of rows whose pred is cls; 0 for none."""
    return scored.agg(F.coalesce(F.avg((F.col("pred") == F.col("cls")).cast("double")), F.lit(0.0)).alias("accuracy"))


def topk_per_prototype(scored: DataFrame, k: int = 7) -> DataFrame:
    """``(proto_id, n, mean ARRAY<DOUBLE>)`` of the k correctly assigned samples that are nearest; ties by key.

    A rank filter over the window lets Spark cut each map partition to k rows per prototype before the exchange.
    """
    right = scored.where("pred = cls")
    near = right.withColumn("r", F.row_number().over(Window.partitionBy("proto_id").orderBy("d2", "key"))).where(F.col("r") <= k)
    long = near.select("proto_id", F.posexplode("features").alias("feature_idx", "v")).groupBy("proto_id", "feature_idx").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return long.groupBy("proto_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("feature_idx", "v"))), lambda s: s["v"]).alias("mean"))


# ---- training -----------------------------------------------------------------------------------------------------------


def levy_scale(beta: float = 1.5) -> float:
    """Deviation of the numerator of a Lévy-stable step (Mantegna's formula)."""
    top = math.gamma(1 + beta) * math.sin(math.pi * beta / 2)
    return (top / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)


def levy_alpha(spark, epochs: int, alpha0: float = 0.3, alpha_min: float = 0.01, power: float = 2.0, p_jump: float = 0.12, k: float = 0.08, beta: float = 1.5, freeze: float = 0.7, seed: int = 0) -> DataFrame:  # noqa: ANN001
    """``(epoch, alpha)``: alpha0 (1 - t/T)^power, sometimes lifted by a Lévy jump before the freeze, within [alpha_min, alpha0]."""
    t = F.col("id").cast("double") / max(1, epochs)
    n1 = F.sqrt(-2 * F.log(1 - uniform(seed, "a", F.col("id")))) * F.cos(2 * math.pi * uniform(seed, "b", F.col("id")))
    n2 = F.sqrt(-2 * F.log(1 - uniform(seed, "c", F.col("id")))) * F.cos(2 * math.pi * uniform(seed, "d", F.col("id")))
    jump = F.abs(levy_scale(beta) * n1 / F.pow(F.greatest(F.abs(n2), F.lit(1e-12)), 1 / beta))
    base = alpha0 * F.pow(F.greatest(F.lit(0.0), 1 - t), F.lit(power))
    lifted = F.when((t < freeze) & (uniform(seed, "j", F.col("id")) < p_jump), base * (1 + k * jump)).otherwise(base)
    return spark.range(epochs).select(F.col("id").cast("int").alias("epoch"), F.greatest(F.lit(alpha_min), F.least(lifted, F.lit(alpha0))).alias("alpha"))


def dropout_mask(prototypes: DataFrame, epoch: int, epochs: int, p: float = 0.15, warmup: int = 10, seed: int = 0) -> DataFrame:
    """``(proto_id, cls, w, active)``: between warm-up and half of the epochs a prototype is off with probability p; one of each class stays on."""
    if not warmup <= epoch < epochs / 2:
        return prototypes.withColumn("active", F.lit(True))
    u = uniform(seed, "drop", epoch, F.col("proto_id"))
    most = F.max(F.struct(u.alias("u"), F.negative("proto_id").alias("neg"))).over(Window.partitionBy("cls"))
    return prototypes.withColumn("active", (u >= p) | (F.col("proto_id") == -most["neg"]))


def class_boxes(data: DataFrame) -> DataFrame:
    """``(cls, r ARRAY<STRUCT<feature_idx, lo, hi>>, box)``: ranges of each class; box: two samples, and every range is positive."""
    ranges = class_ranges(data).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("feature_idx", "lo", "hi"))).alias("r"), F.min((F.col("hi") > F.col("lo")).cast("int")).alias("wide"))
    sizes = data.groupBy("cls").agg(F.count("*").alias("n"))
    return ranges.join(sizes, "cls").select("cls", "r", ((F.col("n") >= 2) & (F.col("wide") == 1)).alias("box"))


def reseed_prototypes(prototypes: DataFrame, data: DataFrame, empty: DataFrame, epoch: int, noise: float = NOISE, seed: int = 0, boxes: DataFrame | None = None) -> DataFrame:
    """``prototypes`` with those of ``empty(proto_id)`` drawn anew.

    Uniform in the class range if the class has two samples and every range is positive; else a random sample of the
    class and normal noise; else unchanged. ``boxes``: the ``class_boxes`` of the data, where they are known already; samples
    are read only for classes without a box.
    """
    flags = empty.select("proto_id").distinct().withColumn("_empty", F.lit(True))
    return _redrawn(prototypes.join(F.broadcast(flags), "proto_id", "left"), data, class_boxes(data) if boxes is None else boxes, epoch, noise, seed)


def _redrawn(prototypes: DataFrame, data: DataFrame, boxes: DataFrame, epoch: int, noise: float, seed: int) -> DataFrame:
    """``(proto_id, cls, w)`` in which prototypes with a true ``_empty`` are drawn anew; one projection over joins with small tables."""
    lone = data.join(F.broadcast(boxes.where("NOT box").select("cls")), "cls", "left_semi")
    pick = lone.groupBy("cls").agg(F.min_by("features", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("key").cast("string")))).alias("sample"))
    todo = prototypes.join(F.broadcast(boxes), "cls", "left").join(F.broadcast(pick), "cls", "left")
    at = lambda i, tag: uniform(seed, tag, epoch, F.col("proto_id"), i)
    box = F.transform("r", lambda s: s["lo"] + (s["hi"] - s["lo"]) * at(s["feature_idx"], "box"))
    near = F.transform("sample", lambda x, i: x + noise * F.sqrt(-2 * F.log(1 - at(i, "n1"))) * F.cos(2 * math.pi * at(i, "n2")))
    new = F.when(F.col("box"), box).when(F.col("sample").isNotNull(), near)
    return todo.select("proto_id", "cls", F.when(F.col("_empty"), F.coalesce(new, F.col("w"))).otherwise(F.col("w")).alias("w"))


def hlvq_epoch(data: DataFrame, prototypes: DataFrame, alpha: float | Column, alpha_error: float = 0.25, k: int = 7, *, epoch: int = 0, reseed: bool = False, seed: int = 0, boxes: DataFrame | None = None) -> DataFrame:
    """One synchronous epoch: ``(proto_id, cls, w)``. ``prototypes`` may have a column ``active``; ``alpha`` may be one of its columns,
    which keeps the compiled plan the same in all epochs.

    Winners are found against the prototypes as they are. Wrong wins push: w - eta * sum(x - w), eta = alpha_error *
    alpha, where eta times the number of pushes is capped at 1. Then each prototype goes by alpha towards the mean of
    its k nearest correct samples, measured from where it was pushed to. Those without a correct win stay, or are
    drawn anew with ``reseed``.
    """
    on = prototypes.where("active") if "active" in prototypes.columns else prototypes
    prototypes = prototypes.withColumn("_alpha", alpha if isinstance(alpha, Column) else F.lit(float(alpha)))
    rate = F.col("_alpha")
    win = nearest_prototype(data, on.select("proto_id", "cls", "w"))
    wrong = win.where("pred <> cls").select("proto_id", F.posexplode("features").alias("i", "v")).groupBy("proto_id", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    push = wrong.groupBy("proto_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("s"))
    step = F.least(alpha_error * rate, 1.0 / F.col("n"))
    moved = prototypes.join(F.broadcast(push), "proto_id", "left")
    moved = moved.select("proto_id", "cls", "_alpha", F.when(F.col("n").isNull(), F.col("w")).otherwise(F.zip_with("w", "s", lambda w, s: w - step * (s - F.col("n") * w))).alias("w"))
    right = win.where("pred = cls").join(F.broadcast(moved.select("proto_id", F.col("w").alias("w1"))), "proto_id")
    d2 = F.aggregate(F.zip_with("features", "w1", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    top = topk_per_prototype(right.withColumn("d2", d2), k)
    out = moved.join(F.broadcast(top), "proto_id", "left").select("proto_id", "cls", F.when(F.col("mean").isNull(), F.col("w")).otherwise(F.zip_with("w", "mean", lambda w, m: w + rate * (m - w))).alias("w"), F.col("mean").isNull().alias("_empty"))
    if not reseed:
        return out.drop("_empty")
    return _redrawn(out, data, class_boxes(data) if boxes is None else boxes, epoch, NOISE, seed)


def best_epoch(history: DataFrame, min_delta: float = 0.0, patience: int = 30) -> DataFrame:
    """``(best_epoch, best_acc, stop_epoch)`` of ``history(epoch, acc_val)``: an epoch is better if it beats the best by more
    than min_delta; the run stops after ``patience`` epochs in a row that aren't. One row of an ordered fold."""
    rows = history.agg(F.sort_array(F.collect_list(F.struct("epoch", "acc_val"))).alias("h"))  # a row per epoch
    start = F.struct(F.lit(-1).alias("best"), F.lit(-1.0).alias("acc"), F.lit(0).alias("bad"), F.lit(-1).alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better, done = x["acc_val"] > s["acc"] + min_delta, s["bad"] >= patience
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        moved = F.struct(F.when(better, x["epoch"]).otherwise(s["best"]).alias("best"), F.when(better, x["acc_val"]).otherwise(s["acc"]).alias("acc"), bad.alias("bad"), x["epoch"].cast("int").alias("stop"))
        return F.when(done, s).otherwise(moved)

    return rows.select(F.aggregate("h", start, step).alias("s")).select(F.col("s.best").alias("best_epoch"), F.col("s.acc").alias("best_acc"), F.col("s.stop").alias("stop_epoch"))


def hlvq_fit(data: DataFrame, epochs: int = 300, total: int = 200, alpha0: float = 0.03, alpha_min: float = 0.001, share: float = 0.2, patience: int = 30, min_delta: float = 0.0, p_drop: float = 0.15, warmup: int = 10, p_jump: float = 0.12, seed: int = 0, noise: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Best prototypes and ``train_history(epoch, alpha, acc_train, acc_val)``.

    A driver loop over epochs: what comes to the driver is the model and two numbers per epoch; the samples stay in
    the cluster, cached once, and their class ranges are found once. The model is re-made from its rows each epoch, which
    cuts the lineage. Training stops after ``patience`` epochs without a better validation accuracy.
    """
    spark = data.sparkSession
    parts = train_val_split(data, share, seed).cache()
    train = parts.where("part IN ('train', 'both')")
    rows = lambda df: [tuple(r) for r in df.select("proto_id", "cls", "w").collect()]  # noqa: E731  MAX_PROTOTYPES rows
    table = lambda w, alpha: spark.createDataFrame([(*r, alpha) for r in w], "proto_id int, cls int, w array<double>, alpha double").coalesce(1)

    def scores(w: list[tuple]) -> tuple[float, float]:
        """Accuracy of training and validation rows, in one pass."""
        hit = (F.col("pred") == F.col("cls")).cast("double")
        shares = [F.coalesce(F.avg(F.when(F.col("part").isin(p, "both"), hit)), F.lit(0.0)) for p in ("train", "val")]
        return tuple(nearest_prototype(parts, table(w, 0.0).drop("alpha")).agg(*shares).first())

    boxes = class_boxes(train)
    boxes = spark.createDataFrame(boxes.collect(), boxes.schema).coalesce(1)  # a row per class
    w = rows(init_prototypes(train, total, seed, noise))
    on_train, best_acc = scores(w)
    best, bad, history = w, 0, [(-1, 0.0, on_train, best_acc)]
    alphas = [r["alpha"] for r in levy_alpha(spark, epochs, alpha0, alpha_min, p_jump=p_jump, seed=seed).orderBy("epoch").collect()]
    for t, alpha in enumerate(alphas):
        on = dropout_mask(table(w, alpha), t, epochs, p_drop, warmup, seed)
        w = rows(hlvq_epoch(train, on, F.col("alpha"), epoch=t, reseed=True, seed=seed, boxes=boxes))
        on_train, acc = scores(w)
        history.append((t, alpha, on_train, acc))
        if acc > best_acc + min_delta:
            best, best_acc, bad = w, acc, 0
        elif (bad := bad + 1) >= patience:
            break
    parts.unpersist()
    return table(best, 0.0).drop("alpha"), spark.createDataFrame(history, "epoch int, alpha double, acc_train double, acc_val double")
