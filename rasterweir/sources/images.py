"""Images, masks and models as tables: reading folders, gray levels, packed and long layout, stores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id STRING, height, width, n_channels, mode, data, status)`` of all image files in a folder and those below it.

    ``image_id`` is the path below the folder, so that equal names in two folders stay apart. Files whose suffix isn't one of SUFFIXES are
    left out; unreadable files stay with status ``bad`` and size -1. A folder without images raises, as Spark does for a path that doesn't
    exist. Sizes alone are cheaper by ``headers.scan_headers``.
    """
    read = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
    found = named_images(read.load(path), path)
    if found.isEmpty():
        raise ValueError(f"no image in {path}")
    return found


#: Scheme and authority of a URI.
_PLACE = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"


def named_images(files: DataFrame, root: str) -> DataFrame:
    """Rows of Spark's image source, of a folder or a stream, by their path below ``root`` (the whole path for files elsewhere) and with a status."""
    path, base = F.regexp_replace("origin", _PLACE, ""), re.sub(_PLACE, "", root).rstrip("/") + "/"
    name = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    found = files.select("image.*").withColumn("image_id", name).where(F.lower(F.regexp_extract("image_id", r"\.[^.]+$", 0)).isin(*SUFFIXES))
    return found.select("image_id", "height", "width", F.col("nChannels").alias("n_channels"), "mode", "data", F.when(F.col("height") < 0, "bad").otherwise("ok").alias("status"))


def to_gray(images: DataFrame, *, keep_bad: bool = False) -> DataFrame:
    """``(image_id, height, width, data)`` with one byte per pixel: 0.299 R + 0.587 G + 0.114 B, rounded; bytes are BGR.

    Images of one channel pass through; four channels ignore the last; other counts raise. Bad images are left out, or
    kept with null data.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for n, data, status in zip(pdf["n_channels"], pdf["data"], pdf["status"], strict=True):
                if status != "ok":
                    out.append(None)
                    continue
                a = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.int64)
                if n == 1:
                    out.append(bytes(data))
                elif n in (3, 4):
                    out.append(((114 * a[:, 0] + 587 * a[:, 1] + 299 * a[:, 2] + 500) // 1000).astype(np.uint8).tobytes())
                else:
                    raise ValueError(f"{n} channels")
            yield pdf[["image_id", "height", "width"]].assign(data=out)

    rows = images if keep_bad else images.where("status = 'ok'")
    return rows.select("image_id", "height", "width", "n_channels", "data", "status").mapInPandas(run, "image_id string, height int, width int, data binary")


def pack(pixels: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Long to packed: ``pixels(image_id, y, x, v)`` -> ``(image_id, height, width, data)``; missing pixels are 0.

    The size is what is given or the largest coordinates of each image; a pixel beyond a given size raises.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = height or int(pdf["y"].max()) + 1, width or int(pdf["x"].max()) + 1
        a = np.zeros((h, w), np.uint8)
        a[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "height": np.int32([h]), "width": np.int32([w]), "data": [a.tobytes()]})

    return pixels.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(run, f"image_id {kind}, height int, width int, data binary")


def unpack(gray: DataFrame) -> DataFrame:
    """Packed to long, every pixel."""
    kind = gray.schema["image_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i, w, data in zip(pdf["image_id"], pdf["width"], pdf["data"], strict=True):
                p = np.arange(len(data), dtype=np.int32)
                yield pd.DataFrame({"image_id": i, "y": p // w, "x": p % w, "v": np.frombuffer(data, np.uint8).astype(np.int32)})

    return gray.select("image_id", "width", "data").mapInPandas(run, f"image_id {kind}, y int, x int, v int")


def run_pixels(runs: DataFrame) -> DataFrame:
    """``label_runs(image_id, region_id, y, x0, x1)`` as one row per pixel."""
    return runs.select("image_id", "region_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """Pixels of regions as runs: neighbours in a row share x minus their rank."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("image_id", "region_id", "y").orderBy("x"))
    return pixels.withColumn("g", F.col("x") - rank).groupBy("image_id", "region_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g")


def store_annotations(path: str, runs: DataFrame, regions: DataFrame, labels: DataFrame, buckets: int = 64) -> int:
    """Label maps, regions and labels of some images merged into a store; the images that were there otherwise stay as they are. Returns the snapshot."""
    return store.merge(path, {"label_runs": runs, "regions": regions, "region_labels": labels}, buckets=buckets)


def load_annotations(spark: SparkSession, path: str, snapshot: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store's tables as of a snapshot, by default the last."""
    snapshot = store.snapshots(spark, path)[-1] if snapshot is None else snapshot
    return tuple(store.read(spark, path, name, snapshot) for name in ("label_runs", "regions", "region_labels"))


def store_model(path: str, scaler: DataFrame, prototypes: DataFrame) -> None:
    """Scaler and prototypes, both keyed by model_id."""
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    prototypes.write.mode("overwrite").parquet(f"{path}/prototypes")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/prototypes")


def write_results(path: str, runs: DataFrame, gray: DataFrame, buckets: int = 64) -> int:
    """Label runs and processed images merged into a store, image by image; an image without runs is kept with none. Returns the snapshot."""
    return store.merge(path, {"label_runs": runs, "gray": gray}, gray.select("image_id"), buckets)
