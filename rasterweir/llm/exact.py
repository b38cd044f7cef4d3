"""Exact dedup with an extendible-hash index on shared files.

1. Directory: the bytes of the distinct keys' texts are summed by key prefix; starting from one bucket, an overfull bucket
   is split and the directory doubled when its depth is reached. The driver sees one number per prefix, never keys or rows.
2. Index: within each Arrow batch equal texts are chained first, so that a text with millions of copies reaches its
   owner once per batch. What is left goes to its bucket; the files of a bucketed table in the shared folder hold a few
   buckets each, texts compressed. The other rows keep only (row id, id of their batch's representative).
3. Owners: a task reads a file bucket by bucket (no exchange), chains the rows of equal keys and compares bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, new_path, written

#: Bytes that a bucket holds before it is split: its distinct texts, and KEY_BYTES for each. A single text may be larger.
BUCKET_BYTES = 4 << 20
KEY_BYTES = 1_024
#: Prefix bits beyond the mean depth that a split can use; the sums on the driver are 2**SLACK per bucket, 2**MOST_BITS at most.
SLACK = 4
MOST_BITS = 21
#: Buckets that share a file of the index, about, where there are more than CORE_FILES files for each core: a task owns the buckets of
#: one file, one after the other, and each file costs its executor child processes (Hadoop sets a local file's mode by one).
FILE_BUCKETS, CORE_FILES = 4, 2
#: Files of the index at most.
MOST_FILES = 1 << 15
#: Rows that are held as Python objects, or sent back, at a time.
OUT_ROWS = 512
#: Stands for a null id among the ids of a group.
NULL_ID = -(1 << 63)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normalised(text: str | None) -> bytes:
    """The bytes that are compared: A-Z lower-cased, nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """(id, text) of a batch, a few hundred rows as Python objects at a time."""
    for i in range(0, b.num_rows, OUT_ROWS):
        part = b.slice(i, OUT_ROWS)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> 1  # 63 bits: a non-negative long, ordered by prefix


def directory(prefix_bytes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Extendible hashing on bytes per prefix: (bucket of each directory entry, global depth).

    ``prefix_bytes`` has 2**D entries. A bucket over ``capacity`` is split by its next bit while D allows it.
    """
    limit = int(len(prefix_bytes)).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(prefix_bytes)])
    depth, todo, leaves = 0, [(0, 0)], []
    while todo:
        local, prefix = todo.pop()
        width = limit - local
        if total[(prefix + 1) << width] - total[prefix << width] > capacity and local < limit:
            todo += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
            depth = max(depth, local + 1)
        else:
            leaves.append((local, prefix))
    return np.repeat(np.arange(len(leaves)), [1 << (depth - local) for local, _ in leaves]), depth


def index_files(buckets: int, cores: int) -> int:
    """Files for that many buckets: enough for all cores, beyond that one for FILE_BUCKETS buckets."""
    return max(1, min(buckets, MOST_FILES, max(CORE_FILES * cores, -(-buckets // FILE_BUCKETS))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each input row, dropped ones too.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    largest id stays. Rows that repeat an id count separately, and all rows with the id that stays are kept. A null
    id orders before all others. Ids are integers; strings that aren't numbers raise. Buckets follow the bytes up to
    2**MOST_BITS of them (8 TB of distinct texts); beyond that they grow. A very long text is one row of its bucket. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, int] = {}
            for i in range(0, b.num_rows, OUT_ROWS):
                for x in b.column(0).slice(i, OUT_ROWS).to_pylist():
                    own = normalised(x)
                    k = _key(hashlib.sha256(own).digest())
                    found[k] = max(found.get(k, 0), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["key", "size"])

    distinct = written(rows.select("text").mapInArrow(keys, "key long, size long").groupBy("key").agg((F.max("size") + KEY_BYTES).alias("size")), "keys")
    whole = distinct.agg(F.sum("size")).first()[0] or 0
    limit = min(MOST_BITS, max(1, whole // bucket_bytes).bit_length() + SLACK)
    found = distinct.groupBy(F.shiftright("key", 63 - limit).alias("prefix")).agg(F.sum("size").alias("size")).toPandas()  # 2**MOST_BITS rows at most
    sizes = np.zeros(1 << limit, np.int64)
    sizes[found["prefix"].to_numpy(np.int64)] = found["size"].to_numpy(np.int64)
    discard(distinct)
    entry, depth = directory(sizes, bucket_bytes)
    buckets = int(entry[-1]) + 1
    shared = spark.sparkContext.broadcast(entry.astype(np.int32))  # 2**depth entries, about the number of buckets

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = itertools.count(TaskContext.get().partitionId() << 33)  # the same ones if a lost task runs again
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            heads: dict[int, list[list]] = {}
            refs: list[tuple[int | None, list]] = []
            for doc, text in _rows(b):
                own = normalised(text)
                digest = hashlib.sha256(own).digest()
                chained = heads.setdefault(_key(digest), [])
                head = next((h for h in chained if _unpacked(h[1]) == own), None)
                if head is None:
                    head = [next(names), packer.compress(own), digest.hex(), 0, NULL_ID]
                    chained.append(head)
                head[3] += 1
                head[4] = max(head[4], NULL_ID if doc is None else doc)
                refs.append((doc, head))
            flat = [(k, h) for k, chained in heads.items() for h in chained]
            n = len(refs)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([-1 - i % 997 for i in range(n)] + [int(shared.value[k >> (63 - depth)]) if depth else 0 for k, _ in flat], pa.int32()),
                    pa.array([d for d, _ in refs] + [h[4] for _, h in flat], pa.int64()),
                    pa.array([h[0] for _, h in refs] + [h[0] for _, h in flat], pa.int64()),
                    pa.array([None] * n + [k for k, _ in flat], pa.int64()),
                    pa.array([None] * n + [h[3] for _, h in flat], pa.int64()),
                    pa.array([None] * n + [h[2] for _, h in flat], pa.string()),
                    pa.array([None] * n + [h[1] for _, h in flat], pa.binary()),
                ],
                names=["bucket", "doc_id", "head", "key", "n", "sha", "data"],
            )
            yield from (out.slice(i, OUT_ROWS) for i in range(0, out.num_rows, OUT_ROWS))

    index = rows.mapInArrow(chain, "bucket int, doc_id long, head long, key long, n long, sha string, data binary")
    path, table = new_path(spark, "hash-index"), f"hash_index_{uuid.uuid4().hex}"
    files = index_files(buckets, spark.sparkContext.defaultParallelism)
    index.repartition(files, "bucket").write.option("path", path).option("compression", "none").bucketBy(files, "bucket").sortBy("bucket", "key").format("parquet").saveAsTable(table)
    index = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalogue forgets the name; the files stay and the plan has found them

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chains: dict[int, list[list]] = {}
        out = []
        for doc, head, k, n, sha, data in zip(pdf["doc_id"].tolist(), pdf["head"], pdf["key"], pdf["n"], pdf["sha"], pdf["data"], strict=True):
            chained = chains.setdefault(int(k), [])
            group = next((g for g in chained if _unpacked(g[0]) == _unpacked(data)), None)
            if group is None:
                group = [data, 0, NULL_ID]
                chained.append(group)
            group[1] += int(n)
            group[2] = max(group[2], doc)
            out.append((int(head), sha, group))
        return pd.DataFrame({"head": [h for h, _, _ in out], "text_sha256": [s for _, s, _ in out], "keep_id": [g[2] for _, _, g in out], "group_size": [g[1] for _, _, g in out]})

    groups = index.where("bucket >= 0").groupBy("bucket").applyInPandas(own, "head long, text_sha256 string, keep_id long, group_size long")
    groups = groups.withColumn("keep_id", F.when(F.col("keep_id") != NULL_ID, F.col("keep_id")))
    members = index.where("bucket < 0").select("doc_id", "head")
    return members.join(groups, "head").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
