"""Helpers of the llm operators: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets one temporary folder per application, which goes when Python ends; any other
    master raises, as its executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.TemporaryDirectory(prefix="spark-shared-", ignore_cleanup_errors=True)
    return "file://" + _own[app].name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; nothing that is still to be computed may read them."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that isn't among the given ones, in any case."""
    taken = {c.lower() for c in columns}
    return next(n for i in range(len(taken) + 1) if (n := f"_{name}_{i}").lower() not in taken)


def memory_bytes(df: DataFrame, row_bytes: int, *strings: str) -> int:
    """What a table takes in memory at most: its rows times their fixed width, and its strings. Checked before a broadcast."""
    size = F.lit(row_bytes).cast("long")
    for c in strings:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    ``edges(a LONG, b LONG)`` -> ``(id LONG, component LONG)`` with the smallest id that is reachable; one row for
    each id that has an edge to another id. Null ends and self-loops are ignored, repeated edges do no harm.

    Alternates the two star operations (every neighbour hooks to the smallest one seen), all as aggregates and
    joins, so that a hub with millions of neighbours is reduced map-side; each round is written to the shared
    folder and the one before is deleted. The number of edges never grows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = written(now, "components"), None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(old)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
