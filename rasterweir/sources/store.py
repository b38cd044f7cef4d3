"""A store of image tables that is updated image by image: snapshots over buckets, switched at once.

``path/data`` holds Parquet folders that are never changed, ``path/snapshots/<n>.json`` says which of them make up
snapshot n. A merge reads and writes the buckets of its images only; the others keep their files. The new snapshot appears
by a rename, so readers see the old one or the new one, and a writer that breaks off leaves files that no snapshot names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots, in order."""
    return sorted(int(n.split(".")[0]) for n in _names(spark, f"{path}/snapshots") if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, snapshot: int | None = None) -> dict:
    """``{"buckets": n, "tables": {name: {"schema": ..., "folders": {bucket: folder}}}}`` of a snapshot, by default the last; a new store has no tables."""
    found = snapshots(spark, path)
    if not found:
        return {"buckets": 0, "tables": {}}
    return json.loads(_read_text(spark, f"{path}/snapshots/{found[-1] if snapshot is None else snapshot}.json"))


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make a snapshot visible; raises if another writer made one of that number meanwhile."""
    fs, hidden = _fs(spark, f"{path}/snapshots/.{uuid.uuid4().hex}")
    _, place = _fs(spark, f"{path}/snapshots/{number}.json")
    stream = fs.create(hidden, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if fs.exists(place) or not fs.rename(hidden, place):
        fs.delete(hidden, False)
        raise RuntimeError(f"another writer has made snapshot {number}")


def _bucket(buckets: int):  # noqa: ANN202
    return F.pmod(F.xxhash64(F.col("image_id").cast("string")), F.lit(buckets)).cast("int")


def merge(path: str, tables: dict[str, DataFrame], images: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replace the rows of some images in each of the tables; returns the new snapshot's number.

    ``tables``: name -> rows with ``image_id``. ``images(image_id)``: the images that are replaced, by default those that have a
    row in any of the tables; an image among them without rows in a table loses those it had. Rows with a null ``image_id`` are one image. ``buckets`` counts
    when the store is made. Tables that aren't named stay as they are; a table of another schema than before raises.
    """
    spark = next(iter(tables.values())).sparkSession
    found = snapshots(spark, path)
    old = manifest(spark, path)
    n, number = old["buckets"] or buckets, (found[-1] + 1 if found else 0)
    if images is None:
        parts = [t.select(F.col("image_id").cast("string").alias("image_id")) for t in tables.values()]
        images = parts[0]
        for p in parts[1:]:
            images = images.union(p)
    ids = images.select(F.col("image_id").cast("string").alias("_id")).distinct().cache()
    touched = sorted(r[0] for r in ids.withColumnRenamed("_id", "image_id").select(_bucket(n)).distinct().collect())  # bucket numbers
    new = {"buckets": n, "tables": dict(old["tables"])}
    for name, rows in tables.items():
        before = old["tables"].get(name, {"schema": rows.schema.jsonValue(), "folders": {}})
        if [(f["name"], f["type"]) for f in before["schema"]["fields"]] != [(f["name"], f["type"]) for f in rows.schema.jsonValue()["fields"]]:
            raise ValueError(f"{name} has other columns than before")
        folders = dict(before["folders"])
        held = [folders.pop(str(b)) for b in touched if str(b) in folders]
        both = rows
        if held:
            kept = spark.read.schema(rows.schema).parquet(*[f"{path}/{f}" for f in held])
            gone = F.col("image_id").cast("string").eqNullSafe(F.col("_id"))
            both = kept.join(ids, gone, "left_anti").unionByName(rows)
        folder = f"data/{name}-{number}-{uuid.uuid4().hex}"
        both.withColumn("_bucket", _bucket(n)).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        folders |= {x.split("=")[1]: f"{folder}/{x}" for x in _names(spark, f"{path}/{folder}") if x.startswith("_bucket=")}
        new["tables"][name] = {"schema": rows.schema.jsonValue(), "folders": folders}
    _commit(spark, path, number, new)
    ids.unpersist()
    return number


def read(spark: SparkSession, path: str, name: str, snapshot: int | None = None) -> DataFrame:
    """A table of a snapshot, by default of the last one there is now; later merges don't change what it reads."""
    from pyspark.sql.types import StructType

    table = manifest(spark, path, snapshot)["tables"].get(name)
    if table is None:
        raise ValueError(f"no table {name} in {path}")
    schema = StructType.fromJson(table["schema"])
    if not table["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in sorted(table["folders"].values())])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forget all but the last ``keep`` snapshots and delete the folders that none of those names; returns how many. Nobody may be writing or reading the forgotten ones."""
    found = snapshots(spark, path)
    for n in found[: len(found) - keep]:
        fs, p = _fs(spark, f"{path}/snapshots/{n}.json")
        fs.delete(p, False)
    used = {f for n in found[-keep:] for t in manifest(spark, path, n)["tables"].values() for f in t["folders"].values()}
    gone = 0
    for folder in _names(spark, f"{path}/data"):
        parts = [f"data/{folder}/{x}" for x in _names(spark, f"{path}/data/{folder}") if x.startswith("_bucket=")]
        unused = [x for x in parts if x not in used]
        for x in [f"data/{folder}"] if len(unused) == len(parts) else unused:
            fs, p = _fs(spark, f"{path}/{x}")
            fs.delete(p, True)
            gone += 1
    return gone
