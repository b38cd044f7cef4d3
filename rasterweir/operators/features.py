"""Region features: one row per region, cut from packed images and label runs; all pixel features in one map.

A region's row holds its filled crop (the box grown by a pad and clamped to the image, in which pixels outside the object
have the truncated median of the object), its mask, and the gray values of the ring around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .regions import border_context

LEVELS = 32
PAD = 12
#: Size of the ellipse that an object is grown by for its ring.
RING = 9
REGION = ["image_id", "region_id"]
#: Regions of an image that a task cuts at most.
PART_REGIONS = 500
# The 30 features in the order of the vector, which stored models and data sets rely on.
FEATURES = [
    "solidity", "holes", "euler", "intensity_std", "intensity_cv", "intensity_iqr", "intensity_entropy", "contrast_mean", "contrast_std", "contrast_entropy",
    "glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation", "lbp_uniformity", "lbp_entropy", "fft_ratio", "spectral_entropy",
    "energy_low", "energy_mid", "energy_high", "edge_density", "gradient_mean", "gradient_std", "laplacian_var", "log_mean", "log_std", "touches_border", "border_distance",
]



INTENSITY = ["mean", "std", "cv", "iqr", "median", "entropy"]
CONTRAST = ["contrast_mean", "contrast_std", "contrast_entropy"]
GLCM = ["glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]
LBP = ["lbp_uniformity", "lbp_entropy"]
SHAPE = ["solidity", "circularity", "holes", "euler"]
SPECTRUM = ["fft_ratio", "spectral_entropy", "energy_low", "energy_mid", "energy_high"]
EDGES = ["edge_density", "gradient_mean", "gradient_std", "laplacian_var", "log_mean", "log_std"]
CROP = "height int, width int, crop binary, mask binary, ring binary"


def _parts(runs: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """``runs`` with ``part INT``, and ``bands(image_id, bands ARRAY<STRUCT<part, lo, hi>>)``: the rows of the image that a part's regions need.

    The regions of an image are taken in the order of their first rows, PART_REGIONS to a part, so a part needs a band of rows, and an image with
    any number of regions is dealt over as many tasks as it has parts.
    """
    boxes = runs.groupBy(*REGION).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("lo", "region_id"))  # three numbers a region
    boxes = boxes.withColumn("part", F.floor((place - 1) / PART_REGIONS).cast("int"))
    bands = boxes.groupBy("image_id", "part").agg((F.min("lo") - reach).alias("lo"), (F.max("hi") + 1 + reach).alias("hi"))
    return runs.join(boxes.select(*REGION, "part"), REGION), bands.groupBy("image_id").agg(F.collect_list(F.struct("part", "lo", "hi")).alias("bands"))


def _bands(gray: DataFrame, bands: DataFrame) -> DataFrame:
    """``(image_id, part, y0, height, width, image_height, data)``: the band of each part, cut where the image lies. Null or short data has none."""
    kind = gray.schema["image_id"].dataType.simpleString()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i, h, w, data, own in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["data"], pdf["bands"], strict=True):
                if data is None or len(data) != h * w:
                    continue
                out = [(i, b["part"], max(0, b["lo"]), min(h, b["hi"]) - max(0, b["lo"]), w, h, bytes(data[max(0, b["lo"]) * w : min(h, b["hi"]) * w])) for b in own]
                yield pd.DataFrame(out, columns=["image_id", "part", "y0", "height", "width", "image_height", "data"])

    rows = gray.select("image_id", "height", "width", "data").join(bands, "image_id")
    return rows.mapInPandas(cut, f"image_id {kind}, part int, y0 int, height int, width int, image_height int, data binary")


def region_crops(gray: DataFrame, runs: DataFrame, pad: int = PAD, *, ring: bool = True) -> DataFrame:
    """``(image_id, region_id, height, width, crop, mask, ring)``: a row per region of ``label_runs`` whose image is in ``gray``.

    A task meets a part of an image's regions (PART_REGIONS at most) with the band of the image that they lie in, and its regions leave as rows of
    their own. The ring is what lies within an ellipse of size RING around the object, inside the image and not in it; other objects'
    pixels belong to it. Without ``ring`` it is empty and isn't looked for. Regions of images with null or short data have no row.
    """
    kind = runs.schema["image_id"].dataType.simpleString()
    near, reach = K.ellipse(RING), RING // 2

    def cut(image: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(image) and len(own):
            first = image.iloc[0]
            a = np.frombuffer(first["data"], np.uint8).reshape(first["height"], first["width"])
            own = own.sort_values(["region_id", "y", "x0"], kind="stable")
            region, y, x0, x1 = own["region_id"].to_numpy(), own["y"].to_numpy() - first["y0"], own["x0"].to_numpy(), own["x1"].to_numpy()
            ends = np.flatnonzero(np.diff(region, append=region[-1] + 1)) + 1
            m = np.zeros(a.shape, bool)
            for i, k in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                box = (y[i:k].min(), y[i:k].max() + 1, x0[i:k].min(), x1[i:k].max())
                grown = lambda n: np.s_[max(0, box[0] - n) : min(a.shape[0], box[1] + n), max(0, box[2] - n) : min(a.shape[1], box[3] + n)]  # noqa: B023, E731
                for r, b, e in zip(y[i:k].tolist(), x0[i:k].tolist(), x1[i:k].tolist(), strict=True):
                    m[r, b:e] = True
                tight = grown(pad)
                around = a[grown(reach)][K.dilate(m[grown(reach)], near) & ~m[grown(reach)]].tobytes() if ring else b""
                fill = int(np.median(a[tight][m[tight]]))
                crop = np.where(m[tight], a[tight], fill).astype(np.uint8)
                out.append((own["image_id"].iloc[0], region[i], *crop.shape, crop.tobytes(), m[tight].astype(np.uint8).tobytes(), around))
                m[grown(0)] = False
        return pd.DataFrame(out, columns=[*REGION, "height", "width", "crop", "mask", "ring"])

    parted, bands = _parts(runs.select(*REGION, "y", "x0", "x1"), max(pad, reach if ring else 0))
    key = ["image_id", "part"]
    pair = _bands(gray, bands).groupBy(*key).cogroup(parted.select(*REGION, "y", "x0", "x1", "part").groupBy(*key))
    return pair.applyInPandas(cut, f"image_id {kind}, region_id int, {CROP}")


def _per_region(crops: DataFrame, names: list[str], fn: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, float]]) -> DataFrame:
    """``fn(crop, mask, ring)`` of every region as columns."""
    kind = crops.schema["image_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = []
            for h, w, crop, mask, ring in zip(pdf["height"], pdf["width"], pdf["crop"], pdf["mask"], pdf["ring"], strict=True):
                got.append(fn(np.frombuffer(crop, np.uint8).reshape(h, w), np.frombuffer(mask, np.uint8).reshape(h, w) > 0, np.frombuffer(ring, np.uint8)))
            yield pd.concat([pdf[REGION].reset_index(drop=True), pd.DataFrame(got, columns=names, dtype=float)], axis=1)

    return crops.mapInPandas(run, f"image_id {kind}, region_id int, " + ", ".join(f"{n} double" for n in names))


def region_intensity(crops: DataFrame) -> DataFrame:
    """mean, std, cv, iqr, median and entropy of the object's pixels."""
    return _per_region(crops, INTENSITY, lambda a, m, ring: K.intensity_features(a[m]))


def region_contrast(crops: DataFrame) -> DataFrame:
    """Object against ring."""
    return _per_region(crops, CONTRAST, lambda a, m, ring: K.contrast_features(a[m], ring))


def region_glcm(crops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Co-occurrence properties of the filled crop."""
    return _per_region(crops, GLCM, lambda a, m, ring: K.glcm_features(a, levels))


def region_lbp(crops: DataFrame) -> DataFrame:
    """Local binary patterns of the object's pixels."""
    return _per_region(crops, LBP, lambda a, m, ring: K.lbp_features(a, m))


def region_shape(crops: DataFrame) -> DataFrame:
    """Solidity, circularity, holes and Euler number."""
    return _per_region(crops, SHAPE, lambda a, m, ring: K.shape_features(m))


def region_spectrum(crops: DataFrame) -> DataFrame:
    """Radial energy shares and spectral entropy."""
    return _per_region(crops, SPECTRUM, lambda a, m, ring: K.spectrum_features(a, m))


def region_band_ratio(crops: DataFrame, share: float = 0.18) -> DataFrame:
    """The plain ratio of two bands: ``fft_ratio`` alone."""
    return _per_region(crops, ["fft_ratio"], lambda a, m, ring: {"fft_ratio": K.two_band_ratio(a, m, share)})


def region_edges(crops: DataFrame) -> DataFrame:
    """Edge density, gradient, Laplacian and LoG statistics."""
    return _per_region(crops, EDGES, lambda a, m, ring: K.edge_features(a, m))


def _measured(a: np.ndarray, m: np.ndarray, ring: np.ndarray) -> dict[str, float]:
    """All pixel features of a region."""
    own = {f"intensity_{k}": v for k, v in K.intensity_features(a[m]).items()}
    return own | K.contrast_features(a[m], ring) | K.glcm_features(a, LEVELS) | K.lbp_features(a, m) | K.shape_features(m) | K.spectrum_features(a, m) | K.edge_features(a, m)


def region_features(regions: DataFrame, sizes: DataFrame, gray: DataFrame, runs: DataFrame, pad: int = PAD) -> DataFrame:
    """All 30 features of ``regions``, by name and as ``features ARRAY<FLOAT>``; non-finite values and regions without pixels give 0."""
    names = [f"intensity_{c}" for c in INTENSITY] + CONTRAST + GLCM + LBP + SHAPE + SPECTRUM + EDGES
    crops = region_crops(gray, runs.join(regions.select(*REGION), REGION, "left_semi"), pad)
    out = regions.select(*REGION).join(_per_region(crops, names, _measured), REGION, "left").join(border_context(regions, sizes), REGION, "left")
    clean = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    out = out.select(*REGION, *[F.coalesce(F.nanvl(clean(c), F.lit(0.0)), F.lit(0.0)).cast("float").alias(c) for c in FEATURES])
    return out.withColumn("features", F.array(*FEATURES))
