"""Pixel statistics and point operations on ``pixels(image_id, y, x, v)``, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gray_histogram(pixels: DataFrame, *keys: str) -> DataFrame:
    """``(image_id, v, n)``; further keys such as region_id may be named."""
    return pixels.groupBy("image_id", *keys, "v").agg(F.count("*").alias("n"))


def _entropy(n: Column, total: Column, eps: float = 0.0) -> Column:
    p = n / total
    return -F.sum(p * F.log2(p + F.lit(eps)))


def image_profile(pixels: DataFrame) -> DataFrame:
    """Size, least, largest, range, mean, population deviation and 256-bin entropy (bits) of each image.

    The histogram (256 rows an image at most) carries all of it, so pixels are aggregated once.
    """
    size = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max("x").alias("x"))
    v, n = F.col("v").cast("double"), F.col("n")
    sums = size.groupBy("image_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.sum("n").alias("total"), F.sum(v * n).alias("s1"), F.sum(v * v * n).alias("s2"), F.sum(n * F.log2(n)).alias("nlogn"),
    )
    mean, total = F.col("s1") / F.col("total"), F.col("total")
    return sums.select(
        "image_id", "height", "width", "v_min", "v_max", (F.col("v_max") - F.col("v_min")).alias("v_range"), mean.alias("mean"),
        F.sqrt(F.greatest(F.col("s2") / total - mean * mean, F.lit(0.0))).alias("std"), F.greatest(F.log2(total) - F.col("nlogn") / total, F.lit(0.0)).alias("entropy"),
    )


def otsu_counts(pixels: DataFrame) -> DataFrame:
    """``(image_id, threshold, n_over)``: the first level that maximises the variance between classes, 0 for one level, and how many pixels are over it.

    Works on the histogram: exact in integers up to the last division, so that equal levels tie exactly.
    """
    up = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    h = gray_histogram(pixels)
    h = h.select("image_id", "v", "n", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    w0, s0, w, s = (F.col(c).cast("double") for c in ("w0", "s0", "w", "s"))
    gap = s0 * w - s * w0
    var = F.when(F.col("w0") < F.col("w"), gap * gap / (w0 * (w - w0))).otherwise(0.0)
    best = h.withColumn("var", var).groupBy("image_id").agg(F.max(F.struct("var", F.negative("v").alias("neg"), "w0")).alias("best"), F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)).alias("over"), F.max("w").alias("w"))
    split = F.col("best.var") > 0
    return best.select("image_id", F.when(split, -F.col("best.neg")).otherwise(0).cast("int").alias("threshold"), F.when(split, F.col("w") - F.col("best.w0")).otherwise(F.col("over")).alias("n_over"))


def otsu_threshold(pixels: DataFrame) -> DataFrame:
    """``(image_id, threshold)``."""
    return otsu_counts(pixels).select("image_id", "threshold")


def foreground(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The pixels over their image's threshold."""
    return pixels.join(thresholds, "image_id").where("v > threshold").drop("threshold")


def minmax_norm(pixels: DataFrame) -> DataFrame:
    """``floor((v - min) * 255 / (max - min))`` per image; constant images become 0."""
    ends = pixels.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).otherwise(0)
    return pixels.join(ends, "image_id").select("image_id", "y", "x", v.cast("int").alias("v"))


def contrast_stretch(pixels: DataFrame, low: float = 2, high: float = 98) -> DataFrame:
    """Percentiles [low, high] to 0..255, clipped and truncated; unchanged where they are equal."""
    ends = pixels.groupBy("image_id").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("e"))
    lo, hi = F.col("e")[0], F.col("e")[1]
    v = F.when(hi > lo, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - lo) * 255 / (hi - lo)))))
    return pixels.join(ends, "image_id").select("image_id", "y", "x", F.coalesce(v, F.col("v")).cast("int").alias("v"))


def gamma_lut(pixels: DataFrame, gamma: float) -> DataFrame:
    """``floor((v / 255) ** (1 / gamma) * 255)``."""
    return pixels.withColumn("v", F.floor(F.pow(F.col("v") / 255, F.lit(1.0 / gamma)) * 255).cast("int"))


def top2_values(pixels: DataFrame) -> DataFrame:
    """``(image_id, top ARRAY<INT>)``: the two largest distinct values, largest first."""
    return pixels.groupBy("image_id").agg(F.slice(F.sort_array(F.collect_set("v"), False), 1, 2).alias("top"))


def top2_mask(pixels: DataFrame) -> DataFrame:
    """The pixels with one of the two largest distinct values of their image that are over 0."""
    return pixels.join(top2_values(pixels), "image_id").where("v > 0 AND array_contains(top, v)").select("image_id", "y", "x")


def mask_algebra(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``and``, ``minus`` or ``or`` of two pixel sets ``(image_id, y, x)``."""
    a, b = a.select("image_id", "y", "x"), b.select("image_id", "y", "x")
    if how not in ("and", "minus", "or"):
        raise ValueError(how)
    return {"and": a.intersect, "minus": a.subtract, "or": lambda o: a.union(o).distinct()}[how](b)
