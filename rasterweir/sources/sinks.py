"""The shared folder of a cluster, and PNG files as a sink."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, tempfile.TemporaryDirectory] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master gets a temporary one, which goes when Python ends; any other master raises, as its
    executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.TemporaryDirectory(prefix="spark-folder-", ignore_cleanup_errors=True)
        root = "file://" + _own[app].name
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table that several parts of a job read, written once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` made; nothing that is still to be computed may read them."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def png(a: np.ndarray) -> bytes:
    """A gray (H x W) or RGB (H x W x 3) byte array as a PNG file."""
    h, w = a.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_files(rows: DataFrame, path: str) -> int:
    """``rows(name STRING, content BINARY)`` as files of a folder; returns how many. Names are given by the rows, so a task that runs twice writes the same files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        n = 0
        for pdf in parts:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with where.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return int(rows.select("name", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0)


def write_png(gray: DataFrame, path: str, suffix: str = ".png") -> int:
    """Packed gray images as PNG files ``<image_id><suffix>``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"name": [f"{i}{suffix}" for i in pdf["image_id"]], "content": [png(np.frombuffer(d, np.uint8).reshape(h, w)) for h, w, d in zip(pdf["height"], pdf["width"], pdf["data"], strict=True)]})

    return write_files(gray.select("image_id", "height", "width", "data").mapInPandas(run, "name string, content binary"), path)
