"""Exact per-sample training of the prototype classifier: a task per setting, samples streamed from shared files.

Each epoch goes through the training samples in an order of its own. The winner among the active prototypes is found
against the prototypes as they are at that moment; a wrong winner is pushed away at once. After the samples each
prototype goes towards the mean of the nearest samples that it won rightly, measured from where it is by then; one that
won none is drawn anew. Draws are MD5 hashes of (seed, epoch, ids), as in the synchronous form.

Samples are written to shared files in buckets of about BUCKET_ROWS by a hash of the key; an epoch takes the buckets in an
order of its own and sorts each by hash, so a task holds one bucket, HELD_BYTES of others, and 13 bytes per sample for what it knows of all.
No sample passes the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import dropped, saved
from .model import NOISE, levy_scale

BUCKET_ROWS = 50_000
#: Distances that are held at a time, samples whose distances are taken before their turn, and bytes of features that a task keeps between epochs.
STEP = 1 << 21
AHEAD = 64
HELD_BYTES = 128 << 20
DEFAULTS = {"total": 200, "epochs": 300, "alpha0": 0.03, "alpha_min": 0.001, "share": 0.2, "patience": 30, "min_delta": 0.0, "p_drop": 0.15, "warmup": 10, "p_jump": 0.12, "noise": 0.05, "alpha_error": 0.25, "k": 7}
OUT = "config_id int, best_epoch int, epochs_run int, acc_train double, acc_val double, prototypes array<struct<proto_id:int,cls:int,w:array<double>>>"


def draw(*parts: object) -> float:
    """A number in [0, 1) from the MD5 of the parts joined by colons."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / float(1 << 48)


def rank_of(*parts: object) -> int:
    """The first 64 bits of that MD5, for orders."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def ranks_of(keys: np.ndarray, *parts: object) -> np.ndarray:
    """rank_of of the parts and each key."""
    head = "".join(f"{p}:" for p in parts)
    return np.frombuffer(b"".join([hashlib.md5(f"{head}{k}".encode()).digest()[:8] for k in keys.tolist()]), ">u8").astype(np.uint64)


def draws_of(n: int, *parts: object) -> np.ndarray:
    """draw of the parts and each of 0 to n - 1."""
    head = "".join(f"{p}:" for p in parts)
    return np.frombuffer(b"".join([b"\0\0" + hashlib.md5(f"{head}{k}".encode()).digest()[:6] for k in range(n)]), ">u8") / float(1 << 48)


def normal(u: float, v: float) -> float:
    return math.sqrt(-2 * math.log(1 - u)) * math.cos(2 * math.pi * v)


def alpha_at(t: int, c: dict) -> float:
    """Step size of epoch t: a falling power, lifted by a Lévy jump now and then before 70 % of the epochs."""
    share, seed = t / max(1, c["epochs"]), c["seed"]
    alpha = c["alpha0"] * max(0.0, 1 - share) ** 2.0
    if share < 0.7 and draw(seed, "j", t) < c["p_jump"]:
        n1, n2 = normal(draw(seed, "a", t), draw(seed, "b", t)), normal(draw(seed, "c", t), draw(seed, "d", t))
        alpha *= 1 + 0.08 * abs(levy_scale(1.5) * n1 / max(abs(n2), 1e-12) ** (1 / 1.5))
    return max(c["alpha_min"], min(alpha, c["alpha0"]))


class Samples:
    """Buckets of ``(key, features, cls)`` in shared files; those that fit in HELD_BYTES are read once."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True))
        files: dict[int, list[str]] = {}
        for f in found:
            if f.path.endswith(".parquet"):
                files.setdefault(int(f.path.rsplit("bucket=", 1)[1].split("/")[0]), []).append(f.path)
        self.files = dict(sorted(files.items()))
        self.held, self.room = {}, HELD_BYTES

    def bucket(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, features and classes in the order of keys."""
        import pyarrow.parquet as pq

        if b in self.held:
            return self.held[b]
        parts = [pq.ParquetFile(self.fs.open_input_file(p)).read() for p in sorted(self.files[b])]
        key = np.concatenate([p.column("key").to_numpy() for p in parts])
        cls = np.concatenate([p.column("cls").to_numpy() for p in parts])
        x = np.concatenate([p.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(p.num_rows, -1) for p in parts])
        order = np.argsort(key, kind="stable")
        out = key[order], x[order].astype(float), cls[order]
        if out[1].nbytes <= self.room:
            self.held[b], self.room = out, self.room - out[1].nbytes
        return out

    def all(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        for b in self.files:
            yield b, self.bucket(b)


def _split(samples: Samples, c: dict) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Masks of training and validation rows per bucket: the rows of least hashes validate, a class missing there makes both of all training rows."""
    ranks = {b: ranks_of(key, c["seed"]) for b, (key, _, _) in samples.all()}
    flat = np.concatenate(list(ranks.values()))
    n_val = max(1, min(len(flat) - 1, round(len(flat) * c["share"])))
    cut = np.partition(flat, n_val - 1)[n_val - 1]
    val = {b: r <= cut for b, r in ranks.items()}
    train = {b: ~v for b, v in val.items()}
    every, seen = set(), set()
    for b, (_, _, cls) in samples.all():
        every |= set(cls.tolist())
        seen |= set(cls[val[b]].tolist())
    return train, train if every - seen else val


def _ranges(samples: Samples, train: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Per class: rows, least, largest and deviation of each feature among training rows."""
    out: dict[int, list] = {}
    for b, (_, x, cls) in samples.all():
        for k in np.unique(cls[train[b]]).tolist():
            own = x[train[b] & (cls == k)]
            new = [len(own), own.min(axis=0), own.max(axis=0), own.mean(axis=0), ((own - own.mean(axis=0)) ** 2).sum(axis=0)]
            if k in out:
                n, lo, hi, mean, m2 = out[k]
                apart, total = new[3] - mean, n + new[0]
                new = [total, np.minimum(lo, new[1]), np.maximum(hi, new[2]), mean + apart * new[0] / total, m2 + new[4] + apart**2 * n * new[0] / total]
            out[k] = new
    return {k: (n, lo, hi, np.where(np.sqrt(m2 / n) < 1e-6, 0.01, np.sqrt(m2 / n))) for k, (n, lo, hi, _, m2) in sorted(out.items())}


def _start(samples: Samples, train: dict[int, np.ndarray], ranges: dict[int, tuple], c: dict) -> tuple[np.ndarray, np.ndarray]:
    """First prototypes: a class's samples of least hashes, jittered and clipped."""
    if len(ranges) < 2:
        raise ValueError("two classes are needed at least")
    base, rest = divmod(c["total"], len(ranges))
    want = {k: base + (i < rest) for i, k in enumerate(ranges)}
    best: dict[int, list] = {k: [] for k in ranges}
    for b, (key, x, cls) in samples.all():
        rows = np.flatnonzero(train[b])
        for i, r in zip(rows.tolist(), ranks_of(key[rows], c["seed"]).tolist(), strict=True):
            best[cls[i]].append((r, key[i], x[i]))
        best = {k: sorted(v, key=lambda r: r[:2])[: want[k]] for k, v in best.items()}
    w, of = [], []
    for k in ranges:
        _, lo, hi, sd = ranges[k]
        for slot in range(want[k]):
            v, p = best[k][slot % len(best[k])][2], len(w)
            jitter = np.array([normal(draw(c["seed"], "u", p, f), draw(c["seed"], "v", p, f)) for f in range(len(v))]) if c["noise"] else 0.0
            w.append(np.minimum(hi, np.maximum(lo, v + c["noise"] * sd * jitter)) if c["noise"] else v.copy())
            of.append(k)
    return np.array(w), np.array(of)


def _active(of: np.ndarray, t: int, c: dict) -> np.ndarray:
    on = np.ones(len(of), bool)
    if c["warmup"] <= t < c["epochs"] / 2:
        u = draws_of(len(of), c["seed"], "drop", t)
        on = u >= c["p_drop"]
        for k in np.unique(of):
            own = np.flatnonzero(of == k)
            on[own[np.lexsort((own, -u[own]))[0]]] = True
    return on


def _apart(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - w[None, :, :]) ** 2).sum(axis=-1)


def _slack(features: int) -> float:
    """How far rounding may move a squared distance by products from that by differences, as a share of the two vectors' squares."""
    return 8 * (features + 8) * np.finfo(float).eps


def _nearest(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nearest prototype of each row by squared differences, the first of equal ones.

    Products are many times faster than differences, but round otherwise; rows for which they leave several within rounding are compared by differences.
    """
    out, ww = np.empty(len(x), np.int64), (w * w).sum(axis=1)
    step = max(1, STEP // max(1, w.size))
    for at in range(0, len(x), step * w.shape[1]):
        own = x[at : at + step * w.shape[1]]
        d = ww - 2 * (own @ w.T)
        win = d.argmin(axis=1)
        bound = d.min(axis=1) + _slack(x.shape[1]) * ((own * own).sum(axis=1) + ww.max())
        close = np.flatnonzero((d <= bound[:, None]).sum(axis=1) != 1)
        for i in range(0, len(close), step):
            win[close[i : i + step]] = _apart(own[close[i : i + step]], w).argmin(axis=1)
        out[at : at + step * w.shape[1]] = win
    return out


def _pass(samples: Samples, train: dict[int, np.ndarray], w: np.ndarray, of: np.ndarray, on: np.ndarray, eta: float, t: int, c: dict) -> tuple[dict[int, np.ndarray], dict[int, tuple]]:
    """One pass with pushes, in place; winners of rightly won samples (-1 for others), and the first sample of each class in the epoch's order.

    Winners are those of ``_nearest`` against the prototypes as they are at that moment: products are taken for AHEAD samples at a time, and after
    a push those of the prototype that moved are taken again.
    """
    won, first, class_of = {}, {}, of.tolist()
    open_ = np.flatnonzero(on)
    ww = np.where(on, (w * w).sum(axis=1), np.inf)
    most = float(ww[open_].max())
    for b in sorted(samples.files, key=lambda b: rank_of(c["seed"], t, f"b{b}")):
        key, x, cls = samples.bucket(b)
        rows = np.flatnonzero(train[b])
        ranks = ranks_of(key[rows], c["seed"], t)
        by_rank = np.lexsort((rows, ranks))
        order, ranks = rows[by_rank], ranks[by_rank]
        for k, i in zip(*np.unique(cls[order], return_index=True), strict=True):
            if k not in first or ranks[i] < first[k][0]:
                first[k] = (ranks[i], x[order[i]])
        winners = np.full(len(order), -1, np.int32)
        own, label = x[order], cls[order].tolist()
        slack = _slack(x.shape[1])
        square = (own * own).sum(axis=1).tolist()
        for at in range(0, len(order), AHEAD):
            ahead = own[at : at + AHEAD]
            d = ww - 2 * (ahead @ w.T)
            for i, row in enumerate(d):
                g = int(row.argmin())
                if np.count_nonzero(row <= row[g] + slack * (square[at + i] + most)) != 1:
                    g = int(open_[_apart(ahead[i : i + 1], w[open_])[0].argmin()])
                if class_of[g] == label[at + i]:
                    winners[at + i] = g
                    continue
                w[g] -= eta * (ahead[i] - w[g])
                ww[g] = w[g] @ w[g]
                most = max(most, float(ww[g]))
                d[i + 1 :, g] = ww[g] - 2 * (ahead[i + 1 :] @ w[g])
        won[b] = np.full(len(key), -1, np.int32)
        won[b][order] = winners
    return won, first


def _gathered(samples: Samples, won: dict[int, np.ndarray], w: np.ndarray, of: np.ndarray, ranges: dict, first: dict, alpha: float, t: int, c: dict) -> np.ndarray:
    """Prototypes after an epoch: towards the nearest samples won, or drawn anew."""
    near: dict[int, list] = {}
    for b, (key, x, _) in samples.all():
        for g in np.unique(won[b][won[b] >= 0]).tolist():
            own = np.flatnonzero(won[b] == g)
            d = ((x[own] - w[g]) ** 2).sum(axis=-1)
            pick = np.lexsort((key[own], d))[: c["k"]]
            near[g] = sorted(near.get(g, []) + [(d[i], key[own[i]], x[own[i]]) for i in pick.tolist()], key=lambda r: r[:2])[: c["k"]]
    out = w.copy()
    for g in range(len(w)):
        if g in near:
            out[g] = w[g] + alpha * (np.mean([v for _, _, v in near[g]], axis=0) - w[g])
            continue
        n, lo, hi, _ = ranges[of[g]]
        if n >= 2 and (hi > lo).all():
            out[g] = lo + (hi - lo) * draws_of(w.shape[1], c["seed"], "box", t, g)
        elif of[g] in first:
            out[g] = first[of[g]][1] + NOISE * np.array([normal(draw(c["seed"], "n1", t, g, f), draw(c["seed"], "n2", t, g, f)) for f in range(w.shape[1])])
    return out


def _accuracy(samples: Samples, parts: tuple[dict, dict], w: np.ndarray, of: np.ndarray) -> tuple[float, float]:
    hits, total = [0, 0], [0, 0]
    for b, (_, x, cls) in samples.all():
        good = of[_nearest(x, w)] == cls
        for k, part in enumerate(parts):
            hits[k] += int(good[part[b]].sum())
            total[k] += int(part[b].sum())
    return tuple(h / n if n else 0.0 for h, n in zip(hits, total, strict=True))


def train(path: str, setting: dict) -> dict:
    """One setting, from its samples' folder: the best prototypes by validation accuracy, and how training went."""
    c, samples = DEFAULTS | setting, Samples(path)
    parts = _split(samples, c)
    ranges = _ranges(samples, parts[0])
    w, of = _start(samples, parts[0], ranges, c)
    on_train, acc = _accuracy(samples, parts, w, of)
    best, bad, t = (acc, -1, on_train, w.copy()), 0, -1
    for t in range(c["epochs"]):
        alpha = alpha_at(t, c)
        won, first = _pass(samples, parts[0], w, of, _active(of, t, c), c["alpha_error"] * alpha, t, c)
        w = _gathered(samples, won, w, of, ranges, first, alpha, t, c)
        on_train, acc = _accuracy(samples, parts, w, of)
        if acc > best[0] + c["min_delta"]:
            best, bad = (acc, t, on_train, w.copy()), 0
        elif (bad := bad + 1) >= c["patience"]:
            break
    protos = [{"proto_id": p, "cls": int(of[p]), "w": best[3][p].tolist()} for p in range(len(of))]
    return {"best_epoch": best[1], "epochs_run": t + 1, "acc_train": best[2], "acc_val": best[0], "prototypes": protos}


def hlvq_sweep(data: DataFrame, configs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact sequential training for each row of ``configs``: ``(config_id, best_epoch, epochs_run, acc_train, acc_val, prototypes)``.

    configs: ``config_id`` and ``seed``, and any of DEFAULTS as further columns. ``data(key LONG, features, cls)`` of any number of rows
    without nulls in features or class (such rows are left out), all of one length. The best epoch is the first of highest validation accuracy, -1 for the start;
    dropout, new draws, jumps and patience act as the setting says. Fewer than two classes raise. Settings are trained side by side, a task each.
    """
    rows = data.select(F.col("key").cast("long").alias("key"), F.transform("features", lambda v: v.cast("double")).alias("features"), F.col("cls").cast("int").alias("cls"))
    rows = rows.where("key IS NOT NULL AND features IS NOT NULL AND cls IS NOT NULL AND NOT exists(features, v -> v IS NULL)")
    held = saved(rows, "samples")
    buckets = max(1, -(-held.count() // bucket_rows))
    spread = held.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition(min(buckets, 4096), "bucket")
    from ..sources.sinks import new_folder

    path = new_folder(data.sparkSession, "sample-buckets")
    spread.write.partitionBy("bucket").parquet(path)
    dropped(held)
    names = ["seed", *[c for c in configs.columns if c in DEFAULTS]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        setting = {n: (float(r[n]) if isinstance(DEFAULTS.get(n, 0), float) else int(r[n])) for n in names}
        return pd.DataFrame([{"config_id": int(r["config_id"]), **train(path, setting)}])

    each = configs.select("config_id", *names)
    return saved(each.repartitionByRange(max(1, each.count()), "config_id").groupBy("config_id").applyInPandas(fit, OUT), "sweep")
