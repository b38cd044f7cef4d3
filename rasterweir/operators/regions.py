"""Regions: components of masks as label runs, their statistics, filters, ids and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def region_stats(runs: DataFrame) -> DataFrame:
    """``(image_id, region_id, area, x_min, y_min, x_max, y_max, cx, cy)`` from label runs; max bounds exclusive, centroid truncated."""
    n = F.col("x1") - F.col("x0")
    sums = runs.groupBy("image_id", "region_id").agg(
        F.sum(n).cast("long").alias("area"), F.min("x0").alias("x_min"), F.min("y").alias("y_min"), F.max("x1").alias("x_max"), (F.max("y") + 1).alias("y_max"),
        F.sum((F.col("x0") + F.col("x1") - 1) * n).alias("sx2"), F.sum(F.col("y") * n).alias("sy"),
    )
    return sums.withColumns({"cx": F.floor(F.col("sx2") / (2 * F.col("area"))).cast("int"), "cy": F.floor(F.col("sy") / F.col("area")).cast("int")}).drop("sx2", "sy")


def area_filter(regions: DataFrame, least: int) -> DataFrame:
    """Regions of at least so many pixels."""
    return regions.where(F.col("area") >= least)


def padded_bbox(regions: DataFrame, sizes: DataFrame, padding: int) -> DataFrame:
    """Boxes grown by ``padding`` and clamped to ``sizes(image_id, height, width)``."""
    r = regions.join(sizes, "image_id")
    return r.select(
        "image_id", "region_id", F.greatest(F.col("x_min") - padding, F.lit(0)).alias("px_min"), F.greatest(F.col("y_min") - padding, F.lit(0)).alias("py_min"),
        F.least(F.col("x_max") + padding, F.col("width")).alias("px_max"), F.least(F.col("y_max") + padding, F.col("height")).alias("py_max"),
    )


def border_context(regions: DataFrame, sizes: DataFrame, margin: int = 3) -> DataFrame:
    """``touches_border`` (0 or 1) and ``border_distance``: the least gap to the frame over the shorter side."""
    r = regions.join(sizes, "image_id")
    gap = F.least("x_min", "y_min", F.col("width") - F.col("x_max"), F.col("height") - F.col("y_max"))
    touch = (F.col("x_min") <= margin) | (F.col("y_min") <= margin) | (F.col("x_max") >= F.col("width") - margin) | (F.col("y_max") >= F.col("height") - margin)
    return r.select("image_id", "region_id", touch.cast("int").alias("touches_border"), (gap / F.least("height", "width")).alias("border_distance"))


def relabel(regions: DataFrame) -> DataFrame:
    """``new_id`` 1..n in ascending old id, per image."""
    return regions.withColumn("new_id", F.dense_rank().over(Window.partitionBy("image_id").orderBy("region_id")))


def region_pixels(label_pixels: DataFrame, pixels: DataFrame) -> DataFrame:
    """``(image_id, region_id, y, x, v)``: gray values of the pixels of each region; a missing pixel is 0."""
    return label_pixels.join(pixels, ["image_id", "y", "x"], "left").select("image_id", "region_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def region_ring(label_pixels: DataFrame, sizes: DataFrame, offsets: list[tuple[int, int]], crop_pad: int | None = None) -> DataFrame:
    """``(image_id, region_id, y, x)``: pixels of the image within the offsets of an object and not in it.

    Only the object's boundary pixels are expanded: an inner pixel's ring is covered by them. Other objects' pixels
    belong to the ring. The offsets are a fixed, small list, so the array that is exploded has a fixed length.
    """
    near = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    inner = label_pixels.withColumn("d", F.explode(F.array(*near))).select("image_id", "region_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    inner = inner.groupBy("image_id", "region_id", "y", "x").agg(F.count("*").alias("n")).where("n = 4").drop("n")
    edge = label_pixels.join(inner, ["image_id", "region_id", "y", "x"], "left_anti")
    all_ = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets if (dy, dx) != (0, 0)])
    grown = edge.withColumn("d", F.explode(all_)).select("image_id", "region_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()
    ring = grown.join(label_pixels, ["image_id", "region_id", "y", "x"], "left_anti").join(sizes, "image_id")
    return ring.where("y >= 0 AND x >= 0 AND y < height AND x < width").select("image_id", "region_id", "y", "x")


def class_raster(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Runs of the regions with their predicted class."""
    return runs.join(predictions.select("image_id", "region_id", "cls"), ["image_id", "region_id"])


def accepted_regions(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Runs of class 1 only, with dense new ids per image."""
    kept = relabel(predictions.where("cls = 1").select("image_id", "region_id"))
    return runs.join(kept, ["image_id", "region_id"]).select("image_id", F.col("new_id").alias("region_id"), "y", "x0", "x1")


def label_summary(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """``(image_id, regions, positive, negative, unlabelled)``."""
    r = regions.join(labels, ["image_id", "region_id"], "left")
    one = F.coalesce(F.sum((F.col("cls") == 1).cast("long")), F.lit(0))
    none = F.coalesce(F.sum((F.col("cls") == 0).cast("long")), F.lit(0))
    return r.groupBy("image_id").agg(F.count("*").alias("regions"), one.alias("positive"), none.alias("negative")).withColumn("unlabelled", F.col("regions") - F.col("positive") - F.col("negative"))


def unlabelled_regions(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Regions without a label."""
    return regions.join(labels, ["image_id", "region_id"], "left_anti")


def labelled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with a label."""
    return images.join(labels, "image_id", "left_semi")
