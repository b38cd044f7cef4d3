"""Image quality: metrics, flags by rule, correction plans, corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Default decision thresholds (fixed values).
THRESHOLDS = {"light": 61.03, "noise": 11.46, "noise_high": 8.09, "blur": 201.22, "blur_strong": 190.51, "std": 5.01, "range": 168.97}


def image_stencil_qc(gray: DataFrame) -> DataFrame:
    """``(image_id, light_range, noise, sharpness, gradient)`` of packed images, map-only.

    light_range: of the image smoothed with sigma max(H, W) // 8 (1 at least), in rounded levels; noise: deviation of
    image minus 5 x 5 median; sharpness: variance of the Laplacian; gradient: mean Sobel magnitude. Null data, or a wrong number of bytes: nulls.
    """
    kind = gray.schema["image_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, h, w, data in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["data"], strict=True):
                if data is None or len(data) != h * w or not len(data):
                    out.append((i, None, None, None, None))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w)
                light = np.rint(K.smooth(a, max(1, max(h, w) // 8)))
                out.append((i, float(light.max() - light.min()), float((a - K.median_window(a, 5).astype(float)).std()), float(K.laplacian(a).var()), float(np.hypot(*K.gradient(a)).mean())))
            yield pd.DataFrame(out, columns=["image_id", "light_range", "noise", "sharpness", "gradient"])

    return gray.select("image_id", "height", "width", "data").mapInPandas(run, f"image_id {kind}, light_range double, noise double, sharpness double, gradient double")


def image_qc(pixels: DataFrame, gray: DataFrame) -> DataFrame:
    """All twelve metrics of an image."""
    from .pixels import image_profile

    return image_profile(pixels).join(image_stencil_qc(gray), "image_id")


def qc_flags(qc: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Five booleans by strict comparison with the thresholds."""
    t = THRESHOLDS | (thresholds or {})
    return qc.withColumns({
        "uneven_light": F.col("light_range") > t["light"], "noisy": F.col("noise") > t["noise"], "blurry": F.col("sharpness") < t["blur"],
        "low_contrast": F.col("std") < t["std"], "narrow_range": F.col("v_range") < t["range"],
    })


def _step(name: str, method: str, **params: Column | float) -> Column:
    entries = [x for k, v in params.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(float(v))).cast("double"))]
    return F.struct(F.lit(name).alias("name"), F.lit(method).alias("method"), F.create_map(*entries).alias("params"))


def qc_plan(flags: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``steps ARRAY<STRUCT<name, method, params>>`` in the order light, noise, contrast, edges; rules tested in order.

    "Very noisy" is tested before "noisy", whatever the thresholds; with the default ones the second never applies.
    """
    t = THRESHOLDS | (thresholds or {})
    light = F.when(F.col("uneven_light"), _step("light", "homomorphic", sigma=F.floor(F.least("height", "width") / 8), gain_low=0.3, gain_high=1.5))
    noise = F.when(F.col("noise") > t["noise_high"], _step("denoise_strong", "non_local_means", h=10, template=7, search=21)).when(F.col("noisy"), _step("denoise", "bilateral", d=5, sigma_color=25, sigma_space=5))
    contrast = F.when(F.col("low_contrast") | F.col("narrow_range"), _step("contrast", "clahe", clip=2.5, tiles=8))
    edges = F.when(F.col("sharpness") < t["blur_strong"], _step("sharpen_strong", "unsharp", strength=2.5, sigma=1.5)).when(F.col("blurry"), _step("sharpen", "unsharp", strength=1.2, sigma=1.5))
    return flags.withColumn("steps", F.filter(F.array(light, noise, contrast, edges), lambda s: s.isNotNull()))


def corpus_quantiles(qc: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int | None = None) -> DataFrame:
    """``(metric, share, value)`` over the corpus: exact, or by a sketch of the given accuracy at scale."""
    long = qc.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("m.*")
    at = F.array(*[F.lit(s) for s in shares])
    got = F.percentile_approx("value", at, accuracy) if accuracy else F.percentile("value", at)
    return long.groupBy("metric").agg(got.alias("q")).select("metric", F.explode(F.arrays_zip(at.alias("share"), F.col("q").alias("value"))).alias("z")).select("metric", "z.share", "z.value")
