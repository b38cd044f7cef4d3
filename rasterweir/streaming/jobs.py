"""Incremental jobs over image files: quality metrics, and whole segmentation with several outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rasters, regions
from ..operators.qc import image_stencil_qc
from ..sources.images import named_images, to_gray, unpack
from ..sources.sinks import dropped, saved

IMAGES = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
#: Tables of a segmentation stream, below its output folder.
TABLES = ("quality", "status", "label_runs", "regions")


def _files(spark: SparkSession, path: str, per_batch: int | None) -> DataFrame:
    read = spark.readStream.format("image").schema(IMAGES).option("dropInvalid", False)
    return (read.option("maxFilesPerTrigger", per_batch) if per_batch else read).load(path)


def stream_new_images(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Quality metrics of image files not seen before, of any size and format that Spark's image source reads, appended as Parquet; runs until all are done.

    The checkpoint remembers files. A file that can't be read has a row too, with null metrics.
    """
    gray = to_gray(named_images(_files(spark, path, None), path), keep_bad=True)
    return image_stencil_qc(gray).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _done(spark: SparkSession, out: str, number: int) -> bool:
    fs, p = _path(spark, f"{out}/_log/batch={number}/_SUCCESS")
    return fs.exists(p)


def segment_batch(files: DataFrame, number: int, root: str, out: str, **settings: float) -> None:
    """Segment one micro-batch of files below ``root`` and write its rows of all TABLES, then its entry in the log.

    A batch whose entry exists is left alone, and one that broke off before is written anew over what it left, so repeating a batch adds nothing.
    """
    spark = files.sparkSession
    if _done(spark, out, number):
        return
    gray = saved(to_gray(named_images(files, root), keep_bad=True), "arrived")
    good = gray.where("data IS NOT NULL")
    runs, processed, status = rasters.segment_corpus(good, unpack(good), **settings)
    said = gray.select("image_id").join(status, "image_id", "left").select("image_id", F.coalesce("status", F.lit("failed: unreadable")).alias("status"))
    tables = {"quality": image_stencil_qc(gray), "status": said, "label_runs": runs, "regions": regions.region_stats(runs)}
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    spark.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(f"{out}/_log/batch={number}")
    dropped(gray)


def stream_segments(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int | None = None, **settings: float) -> StreamingQuery:
    """Segmentation of image files not seen before: quality, status, label runs and regions of each; runs until all are done.

    settings: those of ``segment_corpus``. A file that can't be read has a status and null metrics. ``read_segments`` gives the tables.
    """
    run = lambda files, number: segment_batch(files, number, path, out, **settings)
    return _files(spark, path, files_per_batch).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """TABLES of the batches that the log has; what a batch that broke off has left isn't read. Without a batch it raises."""
    fs, p = _path(spark, f"{out}/_log")
    numbers = sorted(int(f.getPath().getName().split("=")[1]) for f in (fs.listStatus(p) if fs.exists(p) else []) if "=" in f.getPath().getName())
    numbers = [n for n in numbers if _done(spark, out, n)]
    if not numbers:
        raise ValueError(f"no finished batch in {out}")
    return {name: spark.read.parquet(*[f"{out}/{name}/batch={n}" for n in numbers]) for name in TABLES}
