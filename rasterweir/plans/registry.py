"""The library's registered queries, each over tables that Spark derives from the given ones, and their SQL.

Numbers are rounded to six digits on both sides. Regions of the raster queries are the 8-connected components of the
activity rasters' set pixels, unless a query says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import corpus_stats, features, labels, model, pixels, qc, rasters, regions
from ..operators import runs as run_tables
from ..operators import sequential
from ..sources import fixtures, headers, images, sinks, store
from ..sources.sinks import saved
from ..streaming import annotations, jobs
from .sql import SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
H, W = fixtures.HEIGHT, fixtures.WIDTH
REGION = ["image_id", "region_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def px(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.activity_pixels(spark, d)


def packed(spark: SparkSession, d: str) -> DataFrame:
    return images.pack(px(spark, d), H, W)


def sizes(df: DataFrame) -> DataFrame:
    return df.select("image_id").distinct().select("image_id", F.lit(H).alias("height"), F.lit(W).alias("width"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return rasters.connected_components(packed(spark, d))


def lab(spark: SparkSession, d: str) -> DataFrame:
    return images.run_pixels(runs(spark, d))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_stats(runs(spark, d))


def own_pixels(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    """Gray values of the pixels of regions of at least so many pixels."""
    keep = regions.area_filter(stats(spark, d), least).select(*REGION)
    return regions.region_pixels(lab(spark, d).join(keep, REGION, "left_semi"), px(spark, d))


# ---- sources and sinks --------------------------------------------------------------------------------------------------


def _written_images(spark: SparkSession, d: str) -> str:
    """Colour PNG files made from the dense images, a broken one and a text file in a folder of the shared place."""
    path = sinks.new_folder(spark, "images")
    gray = images.pack(fixtures.dense_pixels(spark, d), 8, 8)

    def colour(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            content = []
            for data in pdf["data"]:
                a = np.frombuffer(data, np.uint8).reshape(8, 8)
                content.append(sinks.png(np.ascontiguousarray(np.stack([a, 255 - a, (a.astype(int) * 7 % 256).astype(np.uint8)], axis=2))))
            yield pd.DataFrame({"name": [f"{i}.{'PNG' if i % 2 else 'png'}" for i in pdf["image_id"]], "content": content})

    sinks.write_files(gray.mapInPandas(colour, "name string, content binary"), path)
    extra = spark.createDataFrame([("broken.png", bytearray(b"no image")), ("notes.txt", bytearray(b"text"))], "name string, content binary")
    sinks.write_files(extra, path)
    return path


@query
def scan_images(spark: SparkSession, d: str) -> DataFrame:
    """Names, sizes and status of all image files of a folder; the broken one stays, the text file doesn't."""
    found = images.scan_images(spark, _written_images(spark, d))
    return found.select("image_id", "height", "width", "n_channels", "status")


@query
def scan_headers(spark: SparkSession, d: str) -> DataFrame:
    """The same folder by its files' headers: PNG files of three channels, sized without reading pixels."""
    found = headers.scan_headers(spark, _written_images(spark, d)).where("suffix = '.png' AND bytes > 20 AND height >= 8")
    return found.select("image_id", "height", "width", "channels", "status")


@query
def to_gray(spark: SparkSession, d: str) -> DataFrame:
    gray = images.to_gray(images.scan_images(spark, _written_images(spark, d)))
    long = images.unpack(gray)
    return long.select(F.split("image_id", "\\.")[0].cast("long").alias("image_id"), "y", "x", "v")


@query
def annotation_store(spark: SparkSession, d: str) -> DataFrame:
    """Stored and reloaded: images with a label, and how many labels each has."""
    path = sinks.new_folder(spark, "annotations")
    images.store_annotations(path, runs(spark, d), stats(spark, d), _seed_labels(spark, d), 8)
    _, _, found = images.load_annotations(spark, path)
    return found.groupBy("image_id").agg(F.count("*").alias("labels"))


@query
def model_store(spark: SparkSession, d: str) -> DataFrame:
    """Stored and reloaded model, used on all vectors."""
    path, data = sinks.new_folder(spark, "model"), _vectors(spark, d)
    images.store_model(path, model.fit_scaler(data).withColumn("model_id", F.lit("m")), _protos(spark, d).withColumn("model_id", F.lit("m")))
    scaler, protos = images.load_model(spark, path)
    return r6(model.nearest_prototype(data, protos).select(F.col("key").alias("vec_id"), "proto_id", "d2", "pred"), "d2").crossJoin(F.broadcast(scaler.agg(F.count("*").alias("n_features"))))


@query
def write_results(spark: SparkSession, d: str) -> DataFrame:
    """Runs and images merged into a store in two parts and read again: pixels and regions per image."""
    path = sinks.new_folder(spark, "results")
    gray, found = packed(spark, d), runs(spark, d)
    for part in (0, 1):
        images.write_results(path, found.where(F.col("image_id") % 2 == part), gray.where(F.col("image_id") % 2 == part), 8)
    found = store.read(spark, path, "label_runs")
    return found.groupBy("image_id").agg(F.countDistinct("region_id").alias("regions"), F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixels"))


# ---- pixels and quality -------------------------------------------------------------------------------------------------


@query
def image_profile(spark: SparkSession, d: str) -> DataFrame:
    return r6(pixels.image_profile(px(spark, d)), "mean", "std", "entropy")


@query
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the text rasters: large and of very unequal size."""
    return r6(pixels.image_profile(fixtures.text_pixels(spark, d)), "mean", "std", "entropy")


@query
def gray_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pixels.gray_histogram(fixtures.text_pixels(spark, d))


@query
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return pixels.otsu_threshold(px(spark, d))


@query
def text_otsu(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of the text rasters, and how many pixels are over them."""
    return pixels.otsu_counts(fixtures.text_pixels(spark, d)).select("image_id", "n_over")


@query
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return pixels.minmax_norm(px(spark, d))


@query
def contrast_stretch(spark: SparkSession, d: str) -> DataFrame:
    return pixels.contrast_stretch(px(spark, d))


@query
def gamma_lut(spark: SparkSession, d: str) -> DataFrame:
    return pixels.gamma_lut(px(spark, d), 2.2)


@query
def top2_values(spark: SparkSession, d: str) -> DataFrame:
    top = pixels.top2_values(px(spark, d))
    mask = pixels.top2_mask(px(spark, d)).groupBy("image_id").agg(F.count("*").alias("n_pixels"))
    return top.join(mask, "image_id").select("image_id", F.get("top", F.lit(0)).alias("first"), F.get("top", F.lit(1)).alias("second"), "n_pixels")


@query
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Pixels over 20, pixels over 5 in even columns: intersection, difference and union."""
    a, b = px(spark, d).where("v > 20"), px(spark, d).where("v > 5 AND x % 2 = 0")
    parts = [pixels.mask_algebra(a, b, how).withColumn("how", F.lit(how)) for how in ("and", "minus", "or")]
    return reduce(DataFrame.unionByName, parts)


@query
def run_algebra(spark: SparkSession, d: str) -> DataFrame:
    """The same sets as runs, and what is neither, by sweeps over the runs' ends; as pixels."""
    a, b = (run_tables.mask_runs(px(spark, d).where(c)) for c in ("v > 20", "v > 5 AND x % 2 = 0"))
    parts = [run_tables.run_algebra(a, b, how).withColumn("how", F.lit(how)) for how in ("and", "minus", "or")]
    parts.append(run_tables.complement(run_tables.run_algebra(a, b, "or"), sizes(px(spark, d))).withColumn("how", F.lit("neither")))
    return reduce(DataFrame.unionByName, parts).select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "how")


@query
def image_stencil_qc(spark: SparkSession, d: str) -> DataFrame:
    return r6(qc.image_stencil_qc(packed(spark, d)), "light_range", "noise", "sharpness", "gradient")


#: Thresholds near the medians of the activity rasters, so that every rule applies to some images.
RULES = {"light": 16.0, "noise": 19.0, "noise_high": 22.0, "blur": 15000.0, "blur_strong": 13000.0, "std": 24.0, "range": 130.0}


def _qc(spark: SparkSession, d: str) -> DataFrame:
    dense = fixtures.dense_activity(spark, d)
    return qc.image_qc(dense, packed(spark, d))


@query
def qc_flags(spark: SparkSession, d: str) -> DataFrame:
    return qc.qc_flags(_qc(spark, d), RULES).select("image_id", "uneven_light", "noisy", "blurry", "low_contrast", "narrow_range")


@query
def qc_plan(spark: SparkSession, d: str) -> DataFrame:
    steps = qc.qc_plan(qc.qc_flags(_qc(spark, d), RULES), RULES).select("image_id", F.posexplode("steps").alias("step", "s"))
    return steps.select("image_id", "step", F.col("s.name").alias("name"), F.col("s.method").alias("method"), F.col("s.params")["sigma"].alias("sigma"))


@query
def corpus_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return r6(qc.corpus_quantiles(pixels.image_profile(fixtures.text_pixels(spark, d)), ["v_range", "mean", "std", "entropy"]), "value")


@query
def merged_scaler(spark: SparkSession, d: str) -> DataFrame:
    """The scaler of all vectors from states stored batch by batch, one per label, and never read again."""
    path, data = sinks.new_folder(spark, "states"), fixtures.vectors(spark, d)
    for r in data.select(F.coalesce(F.col("label"), F.lit(-1)).alias("label")).distinct().collect():
        corpus_stats.add_batch(corpus_stats.feature_values(data.where(F.coalesce(F.col("label"), F.lit(-1)) == r["label"])), path, str(r["label"]))
    return r6(corpus_stats.state_scaler(corpus_stats.corpus_state(spark, path)), "mu", "sigma")


# ---- regions ------------------------------------------------------------------------------------------------------------


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return lab(spark, d).select("image_id", "region_id", "y", "x")


@query
def tiled_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the set pixels from strips of four rows, joined over their seams; runs with dense ids."""
    found = run_tables.run_components(run_tables.mask_runs(px(spark, d).where("v > 0")), 8, 4)
    return images.run_pixels(found).select("image_id", "region_id", "y", "x")


@query
def run_fill_holes(spark: SparkSession, d: str) -> DataFrame:
    """Holes of the rasters from components of the complement's runs, in strips of seven rows."""
    p = px(spark, d)
    found = run_tables.run_fill_holes(run_tables.mask_runs(p.where("v > 0")), sizes(p), 7)
    return found.select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


@query
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d)


@query
def area_filter(spark: SparkSession, d: str) -> DataFrame:
    return regions.area_filter(stats(spark, d), 20)


@query
def relabel(spark: SparkSession, d: str) -> DataFrame:
    return regions.relabel(regions.area_filter(stats(spark, d), 4)).select("image_id", "region_id", "new_id", "area")


@query
def padded_bbox(spark: SparkSession, d: str) -> DataFrame:
    return regions.padded_bbox(stats(spark, d), sizes(px(spark, d)), 8)


@query
def border_context(spark: SparkSession, d: str) -> DataFrame:
    return r6(regions.border_context(stats(spark, d), sizes(px(spark, d))), "border_distance")


@query
def region_pixels(spark: SparkSession, d: str) -> DataFrame:
    return own_pixels(spark, d)


def _region_inputs(spark: SparkSession, d: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Images, and the runs of their regions of at least so many pixels."""
    gray = saved(packed(spark, d), "gray")
    found = saved(rasters.connected_components(gray), "runs")
    return gray, found.join(regions.area_filter(regions.region_stats(found), least).select(*REGION), REGION, "left_semi") if least > 1 else found


def _crops(spark: SparkSession, d: str, least: int = 4, pad: int = 3) -> DataFrame:
    return features.region_crops(*_region_inputs(spark, d, least), pad)


@query
def region_intensity(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_intensity(features.region_crops(*_region_inputs(spark, d), 0, ring=False)), *features.INTENSITY)


@query
def region_ring(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_ring(lab(spark, d), sizes(px(spark, d)), K.ellipse(9))


@query
def region_contrast(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_contrast(_crops(spark, d, 1)), *features.CONTRAST)


@query
def region_glcm(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_glcm(_crops(spark, d)), *features.GLCM)


@query
def region_lbp(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_lbp(_crops(spark, d)), *features.LBP)


@query
def region_shape(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_shape(_crops(spark, d)), *features.SHAPE)


@query
def region_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_spectrum(_crops(spark, d)), *features.SPECTRUM)


@query
def region_band_ratio(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_band_ratio(_crops(spark, d)), "fft_ratio")


@query
def region_edges(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.region_edges(_crops(spark, d)), *features.EDGES)


@query
def region_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The edge features that SQL can express."""
    names = ["gradient_mean", "gradient_std", "laplacian_var"]
    return r6(features.region_edges(_crops(spark, d)).select(*REGION, *names), *names)


def _features(gray: DataFrame, found: DataFrame, least: int = 20) -> DataFrame:
    """Features of the regions of at least so many pixels, from images and label runs that have been written."""
    big = regions.area_filter(regions.region_stats(found), least)
    return features.region_features(big, gray.select("image_id", "height", "width"), gray, found)


@query
def region_features(spark: SparkSession, d: str) -> DataFrame:
    gray = saved(packed(spark, d), "gray")
    found = saved(rasters.connected_components(gray), "runs")
    return r6(_features(gray, found).drop("features"), *features.FEATURES)


@query
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Otsu foreground of the rasters, its components of 4 pixels or more with dense ids, and their intensity."""
    p = saved(px(spark, d), "pixels")
    over = pixels.foreground(p, pixels.otsu_threshold(p)).withColumn("v", F.lit(1))
    found = saved(rasters.connected_components(images.pack(over, H, W)), "runs")
    big = regions.relabel(regions.area_filter(regions.region_stats(found), 4))
    crops = features.region_crops(images.pack(p, H, W), found.join(big.select(*REGION), REGION, "left_semi"), 0, ring=False)
    return r6(big.join(features.region_intensity(crops), REGION).drop("region_id"), *features.INTENSITY)


FLAGSHIP = "flagship"

# ---- raster jobs --------------------------------------------------------------------------------------------------------


def _set_pixels(masks: DataFrame) -> DataFrame:
    return images.unpack(masks).where("v > 0").select("image_id", "y", "x")


@query
def frequency_filter(spark: SparkSession, d: str) -> DataFrame:
    """High-pass of the dense 8 x 8 images, radius 2."""
    return images.unpack(rasters.frequency_filter(images.pack(fixtures.dense_pixels(spark, d), 8, 8), "high_ideal", fc=2))


@query
def frequency_filter_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All seven kinds on the dense images: checksum of each result."""
    gray = images.pack(fixtures.dense_pixels(spark, d), 8, 8)
    kinds = [f"{side}_{k}" for side in ("high", "low") for k in ("ideal", "butterworth", "gaussian")] + ["band"]
    parts = [images.unpack(rasters.frequency_filter(gray, k, fc=2, low=1, high=3)).groupBy("image_id").agg(F.sum("v").alias("total")).withColumn("kind", F.lit(k)) for k in kinds]
    return reduce(DataFrame.unionByName, parts)


@query
def local_entropy(spark: SparkSession, d: str) -> DataFrame:
    return images.unpack(rasters.local_entropy(packed(spark, d)))


@query
def morphology(spark: SparkSession, d: str) -> DataFrame:
    """3 x 3 dilation and erosion of the set pixels."""
    gray = packed(spark, d)
    parts = [_set_pixels(rasters.morphology(gray, how)).withColumn("how", F.lit(how)) for how in ("dilate", "erode")]
    return parts[0].unionByName(parts[1])


@query
def fill_holes(spark: SparkSession, d: str) -> DataFrame:
    return _set_pixels(rasters.fill_holes(packed(spark, d)))


@query
def clean_mask(spark: SparkSession, d: str) -> DataFrame:
    return _set_pixels(rasters.clean_mask(packed(spark, d)))


@query
def candidate_mask(spark: SparkSession, d: str) -> DataFrame:
    return _set_pixels(rasters.candidate_mask(packed(spark, d), fc=4, area=20))


@query
def candidate_mask_simple(spark: SparkSession, d: str) -> DataFrame:
    return _set_pixels(rasters.candidate_mask_simple(packed(spark, d), fc=4))


@query
def watershed_islands(spark: SparkSession, d: str) -> DataFrame:
    gray = packed(spark, d)
    return images.run_pixels(rasters.watershed_islands(gray, gray, 0.35, 20))


@query
def watershed_mask(spark: SparkSession, d: str) -> DataFrame:
    gray = packed(spark, d)
    found, distance = rasters.watershed_mask(gray, gray)
    return images.run_pixels(found).join(images.unpack(distance).withColumnRenamed("v", "distance"), ["image_id", "y", "x"])


@query
def apply_filters(spark: SparkSession, d: str) -> DataFrame:
    """Each raster through the steps that its quality asks for."""
    plan = qc.qc_plan(qc.qc_flags(_qc(spark, d), RULES), RULES)
    done = rasters.apply_filters(packed(spark, d), plan)
    return images.unpack(done).groupBy("image_id").agg(F.sum("v").alias("total"), F.max("v").alias("v_max")).join(done.select("image_id", "status"), "image_id")


@query
def apply_all_filters(spark: SparkSession, d: str) -> DataFrame:
    """Every known step, one by one, on every raster."""
    names = [F.struct(F.lit("").alias("name"), F.lit(k).alias("method"), F.create_map().cast("map<string,double>").alias("params")) for k in K.STEPS]
    gray = packed(spark, d)
    one = gray.withColumn("s", F.explode(F.array(*names))).select(F.concat_ws(":", "image_id", "s.method").alias("image_id"), "height", "width", "data", F.array("s").alias("steps"))
    done = rasters.apply_filters(one.drop("steps"), one.select("image_id", "steps"))
    return images.unpack(done).groupBy("image_id").agg(F.sum("v").alias("total"))


@query
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    """The 3 x 3 median step through the step runner, as pixels."""
    gray = packed(spark, d)
    step = F.array(F.struct(F.lit("m").alias("name"), F.lit("median").alias("method"), F.create_map().cast("map<string,double>").alias("params")))
    return images.unpack(rasters.apply_filters(gray, gray.select("image_id", step.alias("steps"))))


@query
def segment_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Whole first stage; segments and their pixels per image, and the image's status."""
    found, _, status = rasters.segment_corpus(packed(spark, d), fixtures.dense_activity(spark, d), fc=4, least=20)
    n = found.groupBy("image_id").agg(F.countDistinct("region_id").alias("regions"), F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixels"))
    return status.join(n, "image_id", "left").select("image_id", "status", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("pixels", F.lit(0)).alias("pixels"))


# ---- labels -------------------------------------------------------------------------------------------------------------


def _seed_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.seed_labels(fixtures.seeds(spark, d), runs(spark, d))


@query
def negative_seeds(spark: SparkSession, d: str) -> DataFrame:
    return labels.negative_seeds(fixtures.seeds(spark, d))


@query
def seed_labels(spark: SparkSession, d: str) -> DataFrame:
    return _seed_labels(spark, d)


@query
def valid_clicks(spark: SparkSession, d: str) -> DataFrame:
    return labels.valid_clicks(fixtures.seeds(spark, d), runs(spark, d))


@query
def unlabelled_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.unlabelled_regions(stats(spark, d), _seed_labels(spark, d)).select("image_id", "region_id", "area")


@query
def labelled_images(spark: SparkSession, d: str) -> DataFrame:
    return regions.labelled_images(px(spark, d).select("image_id").distinct(), _seed_labels(spark, d))


@query
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return regions.label_summary(stats(spark, d), _seed_labels(spark, d))


@query
def labelled_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Labels joined with three features of their regions."""
    f = features.region_intensity(_crops(spark, d, 1)).select(*REGION, F.array("mean", "std", "median").alias("features"))
    data = labels.labelled_dataset(_seed_labels(spark, d), f)
    return r6(data.select(*REGION, "cls", *[F.col("features")[i].alias(n) for i, n in enumerate(("mean", "std", "median"))]), "mean", "std", "median")


@query
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_counts(_vectors(spark, d))


@query
def class_raster(spark: SparkSession, d: str) -> DataFrame:
    return images.run_pixels(regions.class_raster(runs(spark, d), _seed_labels(spark, d)).where("cls = 1").drop("cls"))


@query
def accepted_regions(spark: SparkSession, d: str) -> DataFrame:
    return images.run_pixels(regions.accepted_regions(runs(spark, d), _seed_labels(spark, d)))


@query
def annotation_replay(spark: SparkSession, d: str) -> DataFrame:
    return labels.annotation_replay(fixtures.annotation_log(spark, d))


# ---- model --------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.vectors(spark, d).select(F.col("vec_id").alias("key"), "features", "cls")


def _protos(spark: SparkSession, d: str) -> DataFrame:
    """50 prototypes drawn from all rows, written as several results read them."""
    return saved(model.init_prototypes(_vectors(spark, d), 50, 3, noise=0.0), "prototypes")


def _long(df: DataFrame, column: str, value: str, *keys: str | Column) -> DataFrame:
    return r6(df.select(*keys, F.posexplode(column).alias("feature_idx", value)), value)


@query
def fit_scaler(spark: SparkSession, d: str) -> DataFrame:
    return r6(model.fit_scaler(_vectors(spark, d)), "mu", "sigma")


@query
def apply_scaler(spark: SparkSession, d: str) -> DataFrame:
    data = _vectors(spark, d)
    return _long(model.apply_scaler(data, model.fit_scaler(data)), "features", "z", "key")


@query
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return model.train_val_split(_vectors(spark, d), 0.2, 7).select("key", "part")


@query
def class_ranges(spark: SparkSession, d: str) -> DataFrame:
    return r6(model.class_ranges(_vectors(spark, d)), "lo", "hi", "sd")


@query
def init_prototypes(spark: SparkSession, d: str) -> DataFrame:
    return _long(model.init_prototypes(_vectors(spark, d), 41, 3, noise=0.0), "w", "v", "proto_id", "cls")


@query
def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    return r6(model.nearest_prototype(_vectors(spark, d), _protos(spark, d)).select(F.col("key").alias("vec_id"), "proto_id", "d2", "pred"), "d2")


@query
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return r6(model.accuracy(model.nearest_prototype(_vectors(spark, d), _protos(spark, d))), "accuracy")


@query
def topk_per_prototype(spark: SparkSession, d: str) -> DataFrame:
    top = model.topk_per_prototype(model.nearest_prototype(_vectors(spark, d), _protos(spark, d)))
    return _long(top, "mean", "mean_v", "proto_id", "n")


@query
def hlvq_epoch(spark: SparkSession, d: str) -> DataFrame:
    return _long(model.hlvq_epoch(_vectors(spark, d), _protos(spark, d), 0.3), "w", "v", "proto_id", "cls")


@query
def levy_alpha(spark: SparkSession, d: str) -> DataFrame:
    """The schedule with its jumps: as many epochs as the events have hours."""
    epochs = fixtures.table(spark, d, "events").select(F.date_trunc("hour", "ts")).distinct().count()
    return r6(model.levy_alpha(spark, epochs), "alpha")


@query
def dropout_mask(spark: SparkSession, d: str) -> DataFrame:
    return model.dropout_mask(_protos(spark, d), 20, 100, 0.5).select("proto_id", "cls", "active")


@query
def reseed_prototypes(spark: SparkSession, d: str) -> DataFrame:
    p = _protos(spark, d)
    return _long(model.reseed_prototypes(p, _vectors(spark, d), p.where("proto_id % 3 = 0").select("proto_id"), 5), "w", "v", "proto_id", "cls")


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value per user as an accuracy per epoch."""
    return fixtures.table(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("epoch")).agg(F.round(F.avg("value"), 2).alias("acc_val"))


@query
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return model.best_epoch(_history(spark, d), 0.0, 40)


@query
def hlvq_fit(spark: SparkSession, d: str) -> DataFrame:
    """A short training run in which dropout, new seeds, jumps and patience act: history by epoch."""
    return r6(model.hlvq_fit(_vectors(spark, d), epochs=12, warmup=2, patience=5)[1], "alpha", "acc_train", "acc_val")


@query
def hlvq_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Exact sequential training over all rows with the trainer's own settings, one seed per label value."""
    configs = fixtures.table(spark, d, "embeddings").select("label").distinct().where("label IS NOT NULL").select(F.col("label").alias("config_id"), F.col("label").alias("seed"))
    return r6(sequential.hlvq_sweep(_vectors(spark, d), configs).drop("prototypes"), "acc_train", "acc_val")


@query
def classify_regions(spark: SparkSession, d: str) -> DataFrame:
    """From candidate masks on: regions of 20 pixels or more; a prototype per class from the first region of the whole rasters of which object seeds are at least, or under, 38 %."""
    gray = saved(packed(spark, d), "gray")
    found = saved(rasters.connected_components(gray), "runs")
    f = saved(_features(gray, found).select(*REGION, F.transform("features", lambda v: v.cast("double")).alias("features")), "features")
    votes = labels.seed_votes(fixtures.seeds(spark, d), found).select(*REGION, (F.col("pos") / (F.col("pos") + F.col("neg")) >= 0.38).cast("int").alias("cls"))
    scaler = saved(model.fit_scaler(f), "scaler")
    scaled = model.apply_scaler(f.join(votes, REGION), scaler)
    proto = scaled.groupBy("cls").agg(F.min_by("features", F.struct(*REGION)).alias("w")).select(F.col("cls").alias("proto_id"), "cls", "w")
    masks = rasters.candidate_mask(gray, fc=4, area=20)
    return r6(rasters.classify_masks(masks, gray, scaler, saved(proto, "prototypes"), 20)[1], "d2")


# ---- streams ------------------------------------------------------------------------------------------------------------


@query
def stream_new_images(spark: SparkSession, d: str) -> DataFrame:
    """Rasters as PNG files, read by a stream that runs until all are done; the metrics it appended."""
    path, out, state = (sinks.new_folder(spark, n) for n in ("arrivals", "metrics", "progress"))
    sinks.write_png(packed(spark, d), path)
    jobs.stream_new_images(spark, path, out, state).awaitTermination()
    got = spark.read.parquet(out).withColumn("image_id", F.split("image_id", "\\.")[0].cast("int"))
    return r6(got, "light_range", "noise", "sharpness", "gradient")


@query
def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """Rasters as PNG files, segmented by a stream; segments and pixels of each image from the tables of its batches."""
    path, out, state = (sinks.new_folder(spark, n) for n in ("arrivals", "segments", "progress"))
    sinks.write_png(packed(spark, d), path)
    jobs.stream_segments(spark, path, out, state, fc=4, least=20).awaitTermination()
    found = jobs.read_segments(spark, out)
    n = found["regions"].groupBy("image_id").agg(F.count("*").alias("regions"), F.sum("area").alias("pixels"))
    got = found["status"].join(n, "image_id", "left").select(F.split("image_id", "\\.")[0].cast("int").alias("image_id"), "status", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("pixels", F.lit(0)).alias("pixels"))
    return got


@query
def stream_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The annotation log as files that arrive out of order; final labels from the changes that the stream appended."""
    path, out, state = (sinks.new_folder(spark, n) for n in ("actions", "changes", "progress"))
    fixtures.annotation_log(spark, d).repartition(6, F.xxhash64("seq")).write.parquet(path)
    annotations.stream_annotations(spark, path, spark.read.parquet(path).schema, out, state, lateness=1_000_000, files_per_batch=2).awaitTermination()
    return annotations.final_labels(spark.read.parquet(out))
