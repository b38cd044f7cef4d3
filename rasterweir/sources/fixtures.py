"""Raster tables derived by Spark from the driver's tables, so that all jobs grow with those.

activity_pixels: event values summed by user group, day and hour. text_pixels: character codes of documents, 64 a row.
dense_pixels: embeddings as 8 x 8 images. vectors: embeddings with a binary class. seeds and annotation_log: events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the activity rasters.
HEIGHT, WIDTH = 30, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place() -> list[Column]:
    return [F.floor(F.col("user_id") / 5).cast("int").alias("image_id"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")]


def activity_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, v)``, sparse: pixels that no event hits are missing and mean 0.

    Sums of doubles depend on their order, and a sum at a whole number is on either side of it, so sums per task would change with files, splits
    and tasks. Where any order gives the same level, the plain sum is taken; the values of the other pixels are added one by one in the order in
    which the table holds them, file by file, as one sweep over the table would. Nulls are left out.
    """
    place = ["image_id", "y", "x"]
    stored = F.struct("_metadata.file_path", "_metadata.row_index", "value").alias("stored")
    events = table(spark, sf_dir, "events").select(*_place(), stored)
    value, level = F.col("stored.value"), lambda total: F.least(F.lit(255), F.floor(total)).cast("int")
    off = F.count(value) * F.sum(F.abs(value)) * 2.0**-52  # two sums of the same values are no farther apart
    sums = events.groupBy(*place).agg(level(F.sum(value) - off).alias("v"), level(F.sum(value) + off).alias("most"))
    near = sums.where("v <> most").select(*[F.col(c).alias(f"near_{c}") for c in place])
    swept = F.aggregate(F.array_sort(F.collect_list("stored")), F.lit(None).cast("double"), lambda s, e: F.coalesce(s + e["value"], s, e["value"]))
    own = [F.col(c).eqNullSafe(F.col(f"near_{c}")) for c in place]
    swept = events.join(near, own, "left_semi").groupBy(*place).agg(level(swept).alias("v"))
    return sums.where("v = most").drop("most").unionByName(swept)


def dense_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity rasters with every pixel."""
    pixels = activity_pixels(spark, sf_dir)
    grid = spark.range(HEIGHT * WIDTH).select((F.col("id") / WIDTH).cast("int").alias("y"), (F.col("id") % WIDTH).cast("int").alias("x"))
    full = pixels.select("image_id").distinct().join(F.broadcast(grid))  # a fixed number of rows per image
    return full.join(pixels, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def text_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id LONG, y, x, v)``: codes of the characters up to 255."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    chars = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "")).alias("p", "c")).where("c <> ''")
    return chars.select("image_id", (F.col("p") / 64).cast("int").alias("y"), (F.col("p") % 64).cast("int").alias("x"), F.least(F.ascii("c"), F.lit(255)).alias("v"))


def dense_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id LONG, y, x, v)``: each embedding scaled to 0..255 by its own least and largest value."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    e = e.select("image_id", F.array_min("e").alias("lo"), F.array_max("e").alias("hi"), F.posexplode("e").alias("p", "v"))
    v = F.floor((F.col("v") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))).cast("int")
    return e.select("image_id", (F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), v.alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, features ARRAY<DOUBLE>, cls INT, label INT)``; cls 1 is a label under 5."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"), (F.col("label") < 5).cast("int").alias("cls"), "label")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, image_id, y, x, kind)``; every fiftieth event lies outside its image.

    Views and signups are many more than clicks and errors, so a third of them stands for the rarer kinds; there are four kinds of seeds and
    five of events, so purchases are none.
    """
    e = table(spark, sf_dir, "events")
    third = F.col("event_id") % 3 == 0
    kind = F.when(F.col("event_type") == "click", "object").when(F.col("event_type") == "error", "background").when((F.col("event_type") == "view") & third, "crystal").when((F.col("event_type") == "signup") & third, "residue")
    image, y, x = _place()
    x = (F.hour("ts") + F.when(F.col("event_id") % 50 == 0, WIDTH).otherwise(0)).alias("x")
    return e.select("event_id", image, y, x, kind.alias("kind")).where("kind IS NOT NULL")


def annotation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, seq, image_id, action, region_id)`` of labelling sessions."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "undo").when((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0), "clear").when(F.col("event_type") == "view", "mode1").when(F.col("event_type") == "purchase", "mode0")
    k = F.get_json_object("props", "$.k").cast("int")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    log = e.withColumn("seq", rank).select(F.col("user_id").alias("session_id"), "seq", (k % 4).alias("image_id"), action.alias("action"), (F.col("event_id") % 7).cast("int").alias("region_id"))
    return log.where("action IS NOT NULL")
