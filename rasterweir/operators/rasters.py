"""Jobs on packed images, map-only: filters, morphology, components, masks, watershed, whole segmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.images import run_pixels
from ..sources.sinks import saved
from . import regions as R


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def _image(h: int, w: int, data: bytes | None) -> np.ndarray:
    """A packed image as an array; null data and a wrong number of bytes raise ValueError."""
    if data is None:
        raise ValueError("no data")
    if not (h >= 0 and w >= 0) or len(data) != h * w:
        raise ValueError(f"{len(data)} bytes for {h} x {w} pixels")
    return np.frombuffer(data, np.uint8).reshape(int(h), int(w))


def _blank(h: int, w: int) -> bytes:
    return bytes(int(h) * int(w)) if h > 0 and w > 0 else b""


def _arrays(pdf: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    """Image ids and the arrays of the columns (by default the data); rows in which one of them is no image are passed over."""
    for i, h, w, *held in zip(pdf["image_id"], pdf["height"], pdf["width"], *(pdf[c] for c in columns or ("data",)), strict=True):
        try:
            found = [_image(h, w, data) for data in held]
        except (TypeError, ValueError):
            continue
        yield i, *found


def raster_map(gray: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``fn`` on every image: ``(image_id, height, width, data, status)``.

    An image on which it fails becomes all zero, and ``status`` says why; so does one with null data or a wrong number of bytes.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data, status = [], []
            for h, w, held in zip(pdf["height"], pdf["width"], pdf["data"], strict=True):
                try:
                    data.append(np.asarray(fn(_image(h, w, held))).astype(np.uint8).tobytes())
                    status.append("ok")
                except Exception as e:  # noqa: BLE001  one image's failure is its own
                    data.append(_blank(h, w))
                    status.append(f"failed: {e}")
            yield pdf[["image_id", "height", "width"]].assign(data=data, status=status)

    return gray.select("image_id", "height", "width", "data").mapInPandas(run, f"image_id {_kind(gray)}, height int, width int, data binary, status string")


def frequency_filter(gray: DataFrame, kind: str, fc: float = 30, low: float = 10, high: float = 80, order: int = 2) -> DataFrame:
    """Seven kinds of frequency filters; an unknown kind raises at once."""
    K.frequency_filter(np.zeros((2, 2), np.uint8), kind, fc, low, high, order)
    return raster_map(gray, lambda a: K.frequency_filter(a, kind, fc, low, high, order))


def local_entropy(gray: DataFrame, k: int = 13) -> DataFrame:
    """Whole bits of local entropy per pixel."""
    return raster_map(gray, lambda a: K.entropy_map(a, k))


def morphology(masks: DataFrame, how: str, offsets: list[tuple[int, int]] | None = None, times: int = 1) -> DataFrame:
    """dilate, erode, close or open of packed masks (non-zero is set; 1 in the result)."""
    fn = {"dilate": K.dilate, "erode": K.erode, "close": K.close, "open": K.open_}[how]
    offsets = offsets or K.square(3)
    return raster_map(masks, lambda a: fn(a > 0, offsets, times))


def fill_holes(masks: DataFrame) -> DataFrame:
    return raster_map(masks, lambda a: K.fill_holes(a > 0))


def clean_mask(masks: DataFrame, least: int = 50) -> DataFrame:
    """Closed and opened twice by an ellipse of 5, holes filled, regions under ``least`` pixels dropped."""
    e = K.ellipse(5)
    return raster_map(masks, lambda a: K.large(K.fill_holes(K.open_(K.close(a > 0, e, 2), e, 2)), least))


def connected_components(masks: DataFrame, connectivity: int = 8) -> DataFrame:
    """``label_runs(image_id, region_id, y, x0, x1)``; ids in the order of first pixels. Null or short data has no runs.

    An image is one task; ``runs.run_components`` cuts images into strips instead.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i, a in _arrays(pdf):
                y, x0, x1 = K.runs(a > 0)
                label = K.components(a > 0, connectivity)
                yield pd.DataFrame({"image_id": i, "region_id": label[y, x0].astype(np.int32), "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32)})

    return masks.select("image_id", "height", "width", "data").mapInPandas(run, f"image_id {_kind(masks)}, region_id int, y int, x0 int, x1 int")


def apply_filters(gray: DataFrame, steps: DataFrame, extra: dict[str, Callable] | None = None) -> DataFrame:
    """Each image through its own step list: ``steps(image_id, steps ARRAY<STRUCT<name, method, params>>)``.

    Images are dealt anew by how dear their steps are (non-local means costs hundreds of shifts a pixel), so that they
    don't pile up in a task. ``extra``: more steps by name. An unknown step, or one that fails (a parameter it doesn't know,
    a value it can't use), is reported in ``status``; the image stays as it was before that step. An image without a list, or
    with a null one, stays as it is, with status ``ok``; null data or a wrong number of bytes becomes all zero, with a status.
    """
    known = K.STEPS | (extra or {})
    dear = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), F.lit(1), lambda s, x: s + F.when(x["method"] == "non_local_means", 441).when(x["method"] == "bilateral", 25).otherwise(4)) * F.col("height") * F.col("width")
    rows = gray.select("image_id", "height", "width", "data").join(steps.select("image_id", "steps"), "image_id", "left").withColumn("cost", dear)
    rows = rows.repartition(F.floor(F.log2(F.greatest("cost", F.lit(1)))), F.xxhash64("image_id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data, status = [], []
            for h, w, held, plan in zip(pdf["height"], pdf["width"], pdf["data"], pdf["steps"], strict=True):
                said = "ok"
                try:
                    a = _image(h, w, held)
                except (TypeError, ValueError) as e:
                    data.append(_blank(h, w))
                    status.append(f"failed: {e}")
                    continue
                for s in plan if plan is not None else ():
                    if s["method"] not in known:
                        said = f"failed: unknown step {s['method']}"
                        break
                    try:
                        a = np.asarray(known[s["method"]](a, **dict(s["params"] or {}))).astype(np.uint8)
                    except Exception as e:  # noqa: BLE001  one image's failure is its own
                        said = f"failed: {s['method']}: {e}"
                        break
                data.append(a.tobytes())
                status.append(said)
            yield pdf[["image_id", "height", "width"]].assign(data=data, status=status)

    return rows.mapInPandas(run, f"image_id {_kind(gray)}, height int, width int, data binary, status string")


def candidate(a: np.ndarray, fc: float, area: int, k: int) -> np.ndarray:
    """High pass, Otsu, dilation and closing, islands, local entropy on islands, two largest values."""
    n = K.frequency_filter(a, "high_ideal", fc)
    m = K.close(K.dilate(n > K.otsu(n), K.square(3), 2), K.square(3))
    island = K.large(m, area)
    return K.two_maxima(np.where(island, K.entropy_map(n, k), 0))


def candidate_mask(gray: DataFrame, fc: float = 90, area: int = 20, k: int = 13) -> DataFrame:
    """The candidate mask of every image, map-only."""
    return raster_map(gray, lambda a: candidate(a, fc, area, k))


def candidate_mask_simple(gray: DataFrame, fc: float = 80) -> DataFrame:
    """High pass, Otsu, ellipse-5 closing once and opening twice, holes filled."""
    e = K.ellipse(5)

    def one(a: np.ndarray) -> np.ndarray:
        n = K.frequency_filter(a, "high_ideal", fc)
        return K.fill_holes(K.open_(K.close(n > K.otsu(n), e), e, 2))

    return raster_map(gray, one)


ISLAND = "island_id int, oy int, ox int, height int, width int, area long, data binary, mask binary"


def islands(gray: DataFrame, masks: DataFrame, least: int = 50) -> DataFrame:
    """One row per 4-connected island of at least so many pixels: tight crop and mask."""
    rows = gray.select("image_id", "height", "width", "data").join(masks.select("image_id", F.col("data").alias("m")), "image_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, a, m in _arrays(pdf, "data", "m"):
                label = K.components(m > 0, 4)
                for n, area, box in K.label_boxes(label):
                    if area >= least:
                        own = label[box] == n
                        out.append((i, n, box[0].start, box[1].start, *own.shape, area, a[box].tobytes(), own.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "island_id", "oy", "ox", "height", "width", "area", "data", "mask"])

    return rows.mapInPandas(run, f"image_id {_kind(gray)}, {ISLAND}")


def watershed_islands(gray: DataFrame, masks: DataFrame, share: float = 0.35, least: int = 50) -> DataFrame:
    """``label_runs`` of the segments of all islands; ids dense per image, by island and segment.

    A row per island, dealt by size: a giant island doesn't hold up the rest of its image.
    """
    rows = islands(gray, masks, least).repartition(F.floor(F.log2("area")), F.xxhash64("image_id", "island_id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                a, m = (np.frombuffer(b, np.uint8).reshape(r.height, r.width) for b in (r.data, r.mask))
                n, y, x0, x1 = K.label_runs(K.split_island(a, m > 0, share))
                yield pd.DataFrame({"image_id": r.image_id, "island_id": np.int32(r.island_id), "segment": n.astype(np.int32), "y": (y + r.oy).astype(np.int32), "x0": (x0 + r.ox).astype(np.int32), "x1": (x1 + r.ox).astype(np.int32)})

    runs = rows.mapInPandas(run, f"image_id {_kind(gray)}, island_id int, segment int, y int, x0 int, x1 int")
    runs = R.relabel(runs.withColumn("region_id", F.struct("island_id", "segment")))  # a window, so the watershed runs once
    return runs.select("image_id", F.col("new_id").alias("region_id"), "y", "x0", "x1")


def watershed_mask(gray: DataFrame, masks: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The same over whole masks with one maximum: label runs, and the distance map scaled to 0..255."""
    rows = gray.select("image_id", "height", "width", "data").join(masks.select("image_id", F.col("data").alias("m")), "image_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i, a, m in _arrays(pdf, "data", "m"):
                n, y, x0, x1 = K.label_runs(K.split_island(a, m > 0, share))
                yield pd.DataFrame({"image_id": i, "region_id": n.astype(np.int32), "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32)})

    runs = rows.mapInPandas(run, f"image_id {_kind(gray)}, region_id int, y int, x0 int, x1 int")
    return runs, raster_map(masks, lambda m: K.stretch(np.minimum(K.chamfer(m > 0), m.size)))


def segment_corpus(gray: DataFrame, pixels: DataFrame, fc: float = 90, area: int = 20, k: int = 13, share: float = 0.5, least: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage 1 over a corpus: ``label_runs``, processed images, and a status per image (``ok``, ``empty`` or ``failed: why``).

    Candidate mask (per image), quality plan (aggregates), its steps (per image, dealt by cost), masked stretch, watershed
    (per island), ids. Images, processed images and runs are written, as several results read them. An image that fails in a step
    has no regions and all-zero results; the others aren't touched by it. So has an image without rows in ``pixels``, whose quality isn't known
    (``failed: no pixels``), one with null or short data, and one that is lost on the way (``failed: not processed``).
    """
    from . import qc

    gray = saved(gray.select("image_id", "height", "width", "data"), "gray")
    masks = candidate_mask(gray, fc, area, k)
    plan = qc.qc_plan(qc.qc_flags(qc.image_qc(pixels, gray)))
    done = apply_filters(gray, plan)
    both = done.select("image_id", "height", "width", "data", "status").join(masks.select("image_id", F.col("data").alias("m"), F.col("status").alias("ms")), "image_id")
    planned = plan.select("image_id", F.lit(True).alias("planned")).distinct()
    said = F.when(F.col("ms") != "ok", F.col("ms")).when(F.col("planned").isNull(), "failed: no pixels").otherwise(F.col("status"))
    both = both.join(planned, "image_id", "left").withColumn("status", said).drop("ms", "planned")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data, mask = [], []
            said = []
            for h, w, own, m, status in zip(pdf["height"], pdf["width"], pdf["data"], pdf["m"], pdf["status"], strict=True):
                try:
                    cut_out = K.stretch(np.where(_image(h, w, m) > 0, _image(h, w, own), 0)).tobytes() if status == "ok" else None
                except Exception as e:  # noqa: BLE001  one image's failure is its own
                    cut_out, status = None, f"failed: {e}"
                said.append(status)
                data.append(_blank(h, w) if cut_out is None else cut_out)
                mask.append(_blank(h, w) if cut_out is None else m)
            yield pdf[["image_id", "height", "width"]].assign(status=said, data=data, mask=mask)

    processed = saved(both.mapInPandas(cut, f"image_id {_kind(gray)}, height int, width int, status string, data binary, mask binary"), "processed")
    runs = saved(watershed_islands(processed, processed.select("image_id", "height", "width", F.col("mask").alias("data")), share, least), "segments")
    some = runs.select("image_id").distinct().withColumn("some", F.lit(1))
    status = gray.select("image_id").join(processed.select("image_id", "status"), "image_id", "left").join(some, "image_id", "left")
    said = F.when(F.col("status").isNull(), "failed: not processed").when(F.col("status") != "ok", F.col("status")).when(F.col("some").isNull(), "empty").otherwise("ok")
    return runs, processed.select("image_id", "height", "width", "data"), status.select("image_id", said.alias("status"))


def classify_regions(runs: DataFrame, gray: DataFrame, scaler: DataFrame, prototypes: DataFrame, least: int = 80, *, reconnect: bool = True) -> DataFrame:
    """``predictions(image_id, region_id, proto_id, d2, cls)`` of regions of at least so many pixels.

    reconnect: regions that touch become one (8-connected) before they are measured.
    """
    from ..sources.images import pack
    from . import features, model

    kind = runs.schema["image_id"].dataType.simpleString()
    if reconnect:
        runs = connected_components(pack(run_pixels(runs).withColumn("v", F.lit(1))), 8)
    runs = saved(runs.withColumn("image_id", F.col("image_id").cast(kind)), "regions")
    big = R.area_filter(R.region_stats(runs), least)
    vec = features.region_features(big, gray.select("image_id", "height", "width"), gray, runs)
    vec = vec.select("image_id", "region_id", F.transform("features", lambda v: v.cast("double")).alias("features"))
    found = model.nearest_prototype(model.apply_scaler(vec, scaler), prototypes)
    return found.select("image_id", "region_id", "proto_id", "d2", F.col("pred").alias("cls"))


def classify_masks(masks: DataFrame, gray: DataFrame, scaler: DataFrame, prototypes: DataFrame, least: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate masks to their 8-connected regions, predictions, and the runs of class 1 with dense ids."""
    runs = saved(connected_components(masks, 8), "candidates")
    found = saved(classify_regions(runs, gray, scaler, prototypes, least, reconnect=False), "predictions")
    return runs, found, R.accepted_regions(runs, found)
