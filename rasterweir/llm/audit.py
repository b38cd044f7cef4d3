"""How filters interact: for every order of five filters, what each step removes, from one incremental stream over the files.

Documents arrive in available-now micro-batches. A document's mask has a bit for each filter that it fails. Four bits come
from its text; the fifth, "identical to the text of a smaller id", may be set later. Keyed state holds, for each text, the
smallest id so far with its parts and labels; texts share a state by a prefix of their hash, about TEXTS of them, so that a
state is a small table which is updated at once. When a smaller id arrives, the count of the earlier one is retracted from its
mask and added to the mask with the fifth bit. The part counters are a log with one folder for each micro-batch, which a
repeated batch overwrites; their sum doesn't depend on the order in which files arrive.

Everything reported follows from a part's 32 counters, whatever its number of documents.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, memory_bytes, new_path, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Micro-batches take so many bytes of files at least, and there are about so many batches at most.
BATCH_BYTES = 96 << 20
BATCHES = 16
#: Texts that a state aims at.
TEXTS = 2_000
#: Labels are broadcast up to so many bytes (LABEL_BYTES a row, counted).
BROADCAST_BYTES = 64 << 20
LABEL_BYTES = 32
COUNTERS = "part string, mask int, n long, good long, toxic long"
STATE = "texts binary"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at a text alone. Null is the empty text.

    A: under 50 words; B: fewer than 65 distinct words of 100; C: more than 5 capitals A-Z of 100 code points; D: one of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * F.lit(1 << i) for i, f in enumerate(fails[1:], 1)), fails[0].cast("int"))


ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("least", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])


def _combined(buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an Arrow batch as far as they can be told there: for each text its smallest id, as ``(bucket, copy false, ROWS)``; and the
    sums of all others, which are copies whatever comes later, as ``(bucket, copy true, ROWS)`` without a text.

    A hot text reaches its state as a row for each batch of a map task, not as a row for each document. good, toxic: of all n rows.
    """
    for b in batches:
        if not b.num_rows:
            continue
        d = b.to_pandas()
        h1, h2, ids, part = (d[c].to_numpy() for c in ("h1", "h2", "least", "part"))
        order = np.lexsort((part, ids, h2, h1))
        d, h1, h2, ids = d.iloc[order], h1[order], h2[order], ids[order]
        first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        at_least = ids == ids[first][np.cumsum(first) - 1]
        own = d[at_least].groupby(["h1", "h2", "least", "part", "mask"], sort=False)[["n", "good", "toxic"]].sum().reset_index()
        more = d[~at_least].groupby(["part", "mask"], sort=False)[["n", "good", "toxic"]].sum().reset_index()
        own = own.assign(copy=False, bucket=own["h1"].to_numpy() % buckets)
        more = more.assign(copy=True, h1=np.int64(0), h2=np.int64(0), least=np.int64(0), bucket=[zlib.crc32(f"{m}:{p}".encode("utf-8", "replace")) % buckets for p, m in zip(more["part"], more["mask"], strict=True)])
        both = pd.concat([own, more], ignore_index=True)
        both = both.astype({"mask": "int32", "copy": bool, **{c: "int64" for c in ("bucket", "h1", "h2", "least", "n", "good", "toxic")}})
        yield pa.RecordBatch.from_pandas(both[["bucket", "copy", *ROWS.names]], preserve_index=False)


_COMBINED = "bucket long, copy boolean, h1 long, h2 long, least long, part string, mask int, n long, good long, toxic long"
_SUMS = ["n", "good", "toxic"]


def update(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The texts' smallest ids after ``new`` rows, and the changes of counters ``(part, mask, n, good, toxic)``.

    A new smallest id counts under its mask and other rows under the mask with the fifth bit; an id that was the smallest and isn't any more
    is retracted from its mask and added under that with the fifth bit.
    """
    both = pd.concat([held[ROWS.names].assign(old=True), new[ROWS.names].assign(old=False)], ignore_index=True)
    h1, h2, ids = (both[c].to_numpy() for c in ("h1", "h2", "least"))
    order = np.lexsort((ids, h2, h1))
    both, h1, h2, ids = both.iloc[order], h1[order], h2[order], ids[order]
    first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(both) else np.zeros(0, bool)
    least = ids == ids[first][np.cumsum(first) - 1]
    old = both["old"].to_numpy(bool)
    gone, copies = both[old & ~least], both[~least]
    changes = [both[~old & least], copies.assign(mask=copies["mask"] | COPY), gone.assign(**{c: -gone[c] for c in _SUMS})]
    kept = both[least].groupby(["h1", "h2", "least", "part", "mask"], sort=False)[_SUMS].sum().reset_index()
    return kept, pd.concat(changes)[["part", "mask", *_SUMS]]


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    """Changes of counters by a bucket's rows; its state is a table of ROWS in Arrow's format."""
    new = pd.concat(list(frames), ignore_index=True)
    held = pa.ipc.open_stream(bytes(state.get[0])).read_pandas() if state.exists else ROWS.empty_table().to_pandas()
    copy = new["copy"].to_numpy(bool)
    kept, changes = update(held, new[~copy])
    if not copy.all():
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(kept, schema=ROWS, preserve_index=False)
        with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    more = new[copy]
    every = pd.concat([changes, more.assign(mask=more["mask"] | COPY)[["part", "mask", *_SUMS]]])
    every = every.groupby(["part", "mask"], sort=False)[_SUMS].sum().reset_index()
    yield every[(every[_SUMS] != 0).any(axis=1)]


def _bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path, by Spark's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def _pattern(spark: SparkSession, path: str) -> str:
    """A single file as a pattern that matches it alone, as a stream takes a plain path for a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def counters(spark: SparkSession, path: str, labels: DataFrame | None = None, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None, files_per_batch: int | None = None) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of the Parquet files below ``path`` by part and failed filters; each mask that occurs once.

    labels: ``(doc_id, quality, toxic)``; a document is good or toxic if any of its rows says 1; documents without a row and
    null values are neither. A null part is the empty one. A document with a null id is a copy of nothing, and nothing is a
    copy of it. Rows that repeat an id and a text are copies of each other only if a smaller id has the text. Very long texts are
    judged whole, and identity is that of 120 bits of the SHA-256 of all bytes. An empty table gives no rows. Files are read once, in micro-batches of ``batch_bytes``
    (by default a 16th of the table, BATCH_BYTES at least). State is held by the session's state store, about 30 bytes a text.
    """
    schema = spark.read.parquet(path).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{part_col}`").alias("p")).schema
    kinds = f"`{id_col}` {schema['i'].dataType.simpleString()}, `{text_col}` {schema['t'].dataType.simpleString()}, `{part_col}` {schema['p'].dataType.simpleString()}"
    size = batch_bytes or max(BATCH_BYTES, math.ceil(_bytes_of(spark, path) / BATCHES))
    read = spark.readStream.schema(kinds)
    read = read.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else read.option("maxBytesPerTrigger", size)
    docs = read.parquet(_pattern(spark, path)).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    # a row without an id gets a text of its own: no other row meets it
    docs = docs.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.sha2(F.when(F.col("doc_id").isNull(), F.uuid()).otherwise(F.coalesce("text", F.lit(""))), 256).alias("key"))
    half = lambda i: F.conv(F.substring("key", i, 15), 16, 10).cast("long")  # noqa: E731  60 bits each, no sign
    buckets = max(1, math.ceil(spark.read.parquet(path).count() / TEXTS))
    temporary = []
    if labels is not None:
        flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        flags = written(flags.where("good = 1 OR toxic = 1"), "audit-labels")
        temporary.append(flags)
        docs = docs.join(F.broadcast(flags) if memory_bytes(flags, LABEL_BYTES) <= BROADCAST_BYTES else flags, "doc_id", "left")
    else:
        docs = docs.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    docs = docs.select(half(1).alias("h1"), half(16).alias("h2"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("least"), "part", "mask", F.lit(1).cast("long").alias("n"), F.coalesce("good", F.lit(0)).cast("long").alias("good"), F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"))
    changes = docs.mapInArrow(partial(_combined, buckets), _COMBINED).groupBy("bucket").applyInPandasWithState(_changes, COUNTERS, STATE, "update", "NoTimeout")
    log, checkpoint = new_path(spark, "audit-counters"), new_path(spark, "audit-stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    discard(*temporary)
    _delete(spark, checkpoint)
    spark.createDataFrame([], COUNTERS).write.mode("overwrite").parquet(f"{log}/batch=-1")  # the folder is there for an empty table, too
    found = spark.read.schema(COUNTERS).parquet(log)
    return found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where("n <> 0")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def interactions(counts: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: for each part all
    orders of the filters, and a row for each step of an order.

    What a step removes depends on its filter and the set of filters before it only: 80 sums over a part's masks, from
    which the 600 rows follow. A part's total is in all of its rows' ``kept``; a part without documents has no rows.
    """
    n = len(FILTERS)
    cases = [(f, before) for f in range(n) for before in range(1 << n) if not before >> f & 1]
    case = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(b).alias("before")) for f, b in cases]))
    mask, bit = F.col("mask"), F.col("bit")
    fails = mask.bitwiseAND(bit) != 0
    here = fails & (mask.bitwiseAND(F.col("before")) == 0)

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0)))

    sums = counts.withColumn("case", case).select("part", "mask", "n", "good", "toxic", "case.*").groupBy("part", "f", "before").agg(
        total(here, "n").alias("removed"), total(fails & (mask.bitwiseAND(F.col("before")) != 0), "n").alias("redundant"), total(mask == bit, "n").alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), total((mask.bitwiseAND(F.col("before")) == 0) & ~fails, "n").alias("kept"),
    )
    # orders in which exactly these filters come before: those before and those after in any order
    size = F.bit_count("before")
    ways = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), (size + 1).cast("int"))
    shapley = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = [("".join(FILTERS[i] for i in order), k + 1, order[k], sum(1 << i for i in order[:k])) for order in itertools.permutations(range(n)) for k in range(n)]
    table = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")
    out = sums.join(shapley, ["part", "f"]).join(F.broadcast(table), ["f", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
