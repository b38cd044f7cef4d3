"""Sizes of image files from their headers: the data source "imageheaders".

A folder, with those below it, is listed once and dealt to partitions of files; a task reads the beginning of each file and no more
(as far as the size stands there), so a corpus is sized up without reading or decoding a pixel. Predicates on suffix and
file size are decided from the listing, before a file is opened, and those on height and width from the header. Files are
told apart by their path below the folder.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .images import SUFFIXES

SCHEMA = "image_id string, suffix string, bytes long, height int, width int, channels int, status string"
#: Files of a partition, and bytes that are read of a file at a time.
PART_FILES, READ = 256, 1 << 12
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _png(f) -> tuple[int, int, int]:  # noqa: ANN001
    head = f.read(READ)
    w, h, _, colour = struct.unpack(">IIBB", head[16:26])
    return h, w, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour]


def _bmp(f) -> tuple[int, int, int]:  # noqa: ANN001
    head = f.read(READ)
    w, h, _, bits = struct.unpack("<iiHH", head[18:30])
    return abs(h), w, 4 if bits == 32 else 3


def _jpeg(f) -> tuple[int, int, int]:  # noqa: ANN001
    """Segments are walked by their lengths up to the frame header, which has the size."""
    at = 2
    while True:
        f.seek(at)
        head = f.read(20)
        if len(head) < 10 or head[0] != 0xFF:
            raise ValueError("no frame header")
        if head[1] == 0xFF:  # fill byte
            at += 1
        elif 0xC0 <= head[1] <= 0xCF and head[1] not in (0xC4, 0xC8, 0xCC):
            h, w, channels = struct.unpack(">HHB", head[5:10])
            return h, w, channels
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]


def _tiff(f) -> tuple[int, int, int]:  # noqa: ANN001
    """Entries of the first directory: width 256, length 257, samples per pixel 277."""
    head = f.read(8)
    end = "<" if head[:2] == b"II" else ">"
    f.seek(struct.unpack(end + "I", head[4:8])[0])
    n = struct.unpack(end + "H", f.read(2))[0]
    found = {277: 1}
    for k in range(n):
        entry = f.read(12)
        tag, kind = struct.unpack(end + "HH", entry[:4])
        if tag in (256, 257, 277):
            found[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return found[257], found[256], found[277]


MAGIC = ((b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"\xff\xd8", _jpeg), (b"II*\0", _tiff), (b"MM\0*", _tiff))


def size_of(f) -> tuple[int, int, int]:  # noqa: ANN001
    """Height, width and channels of an open image file; raises ValueError for what isn't one. The format is told by content, not by name."""
    start = f.read(8)
    for magic, parse in MAGIC:
        if start.startswith(magic):
            f.seek(0)
            try:
                h, w, channels = parse(f)
            except (struct.error, KeyError) as e:
                raise ValueError(f"the header breaks off: {e}") from e
            if h < 1 or w < 1:
                raise ValueError("no size")
            return h, w, channels
    raise ValueError("no image")


@dataclass
class Files(InputPartition):
    root: str
    files: list[tuple[str, int]] = field(default_factory=list)


class HeaderReader(DataSourceReader):
    """Options: path; files (of a partition)."""

    LISTED = ("suffix", "bytes")
    HEADER = ("height", "width", "channels")

    def __init__(self, options: dict) -> None:
        self.path, self.per = options["path"], int(options.get("files", PART_FILES))
        if self.path.startswith("file:/") and not self.path.startswith("file://"):
            self.path = "file://" + self.path[5:]
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if name in self.LISTED + self.HEADER and f.value is not None and not (type(f) is In and None in f.value):
                self.tests.append((name, type(f), f.value))
            else:
                yield f  # Spark applies it

    def _passes(self, row: dict, names: tuple[str, ...]) -> bool:
        """Null passes no test."""
        return all(row[n] is not None and _TESTS[kind](row[n], value) for n, kind, value in self.tests if n in names)

    def _fs(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        where, root = self._fs()
        root = root.rstrip("/")
        found = []
        for f in where.get_file_info(FileSelector(root, recursive=True)):
            suffix = "." + f.base_name.rsplit(".", 1)[-1].lower() if "." in f.base_name else ""
            if f.type == FileType.File and suffix in SUFFIXES and self._passes({"suffix": suffix, "bytes": f.size}, self.LISTED):
                found.append((f.path[len(root) + 1 :], f.size))
        found.sort()
        return [Files(root, found[i : i + self.per]) for i in range(0, len(found), self.per)]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        if partition is None:  # no files at all
            return
        where, _ = self._fs()
        for name, size in partition.files:
            row = {"image_id": name, "suffix": "." + name.rsplit(".", 1)[-1].lower(), "bytes": size, "height": None, "width": None, "channels": None, "status": "ok"}
            try:
                with where.open_input_file(f"{partition.root}/{name}") as f:
                    row["height"], row["width"], row["channels"] = size_of(f)
            except (OSError, ValueError) as e:
                row["status"] = f"bad: {e}"
            if self._passes(row, self.HEADER):
                yield tuple(row.values())


class HeaderSource(DataSource):
    """The format "imageheaders"."""

    @classmethod
    def name(cls) -> str:
        return "imageheaders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(dict(self.options))


def scan_headers(spark: SparkSession, path: str, files: int = PART_FILES) -> DataFrame:
    """SCHEMA of all image files (by suffix) in a folder and those below it; ``image_id`` is the path below the folder.

    A file that isn't an image, breaks off or can't be read has null sizes and a status that says why; it passes no predicate on sizes.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeaderSource)
    return spark.read.format("imageheaders").option("files", files).load(path)
