"""Sharding by jump consistent hashing: stable keys go to numbered shards without a ring table, with DataFrame functions only.

A key's generator is started by its MD5; its draws make a rising sequence of jumps, and the key lives at the last jump
below the number of shards. The jumps don't depend on that number, so a shard that is appended takes keys only into itself,
1/(n+1) of them, and one walk gives the shards under both numbers.

Spark's long arithmetic raises on overflow, so the 64-bit state is kept as two halves of 32 bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, written

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
#: Steps of the first walk; the few keys that need more go on in a second one, which has as many steps as there are shards.
WALK = 64
#: Rows of a (shard, hash range) in which places are counted, and equal rows that are written out at a time.
RANGE_ROWS = 50_000
#: Bytes of a file that ``write_shards`` aims at.
FILE_BYTES = 256 << 20
LAW = "key"


def key_halves(key: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of the MD5 of a key's text; a null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def _drawn(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 mod 2**64 in halves; no intermediate value reaches 2**50."""
    m1, m0 = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & MASK)

    def split(x: Column) -> tuple[Column, Column]:
        return x.bitwiseAND(0xFFFF), F.shiftright(x, 16)

    def low_product(x: Column, m: Column) -> Column:  # up to multiples of 2**32
        a, b = split(x)
        return a * m + F.shiftleft((b * m).bitwiseAND(0xFFFF), 16)

    a, b = split(lo)
    low = a * m0 + F.shiftleft((b * m0).bitwiseAND(0xFFFF), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(b * m0, 16) + low_product(lo, m1) + low_product(hi, m0)
    return high.bitwiseAND(MASK), low.bitwiseAND(MASK)


def _walk(start: Column, steps: int, shards: int, most: int) -> Column:
    """``steps`` jumps from a state ``(own, last, next, hi, lo)``, none after ``next`` has reached ``most``."""

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _drawn(s["hi"], s["lo"])
        far = ((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        own = F.when(s["next"] < shards, s["next"]).otherwise(s["own"])
        moved = F.struct(own.alias("own"), s["next"].alias("last"), far.alias("next"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["next"] >= most, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def assign(docs: DataFrame, shards: int, grown: int | None = None, key_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard INT`` (0 to ``shards`` - 1) and ``grown_shard INT`` (the shard if there were ``grown`` of them; by
    default one more). Map-only.

    The shard depends on the key's text and the number of shards alone: an id is placed alike as a number and as a string.
    Null keys are placed as the empty text; repeated keys share a shard. Other columns pass through unread; those named
    like the results are replaced. An empty table stays empty. Fewer than one shard, or fewer than before, raises.
    """
    grown = shards + 1 if grown is None else grown
    if shards < 1 or grown < shards:
        raise ValueError("there must be a shard, and not fewer shards than before")
    names = [c for c in docs.columns if c.lower() not in ("shard", "grown_shard")]
    at = fresh("jump", docs.columns)
    hi, lo = key_halves(F.col(f"`{key_col}`"))
    start = F.struct(F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("next"), hi.alias("hi"), lo.alias("lo"))
    out = docs.select(*[F.col(f"`{c}`") for c in names], _walk(start, min(WALK, grown), shards, grown).alias(at))
    if grown > WALK:
        more = _walk(F.col(at), grown - WALK, shards, grown)  # a jump is one at least, so this ends every walk
        out = out.withColumn(at, F.when(F.col(at)["next"] >= grown, F.col(at)).otherwise(more))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(at)["own"].cast("int").alias("shard"), F.col(at)["last"].cast("int").alias("grown_shard"))


def layout(docs: DataFrame, shards: int, grown: int | None = None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``: one row for each input row.

    size: UTF-8 bytes of the text and 8; a null text has none and the checksum of the empty one. slot: gapless places from 0 in
    the shard, in the order of a hash of (key, size, checksum), so they don't depend on partitions. Rows that are equal in
    these three are interchangeable: they are counted before anything is moved and written out at the end, so repeated rows,
    even a third of the table, never meet in a task. Places are counted in hash ranges of about RANGE_ROWS rows. Texts are
    read for size and checksum only and never moved. An empty table gives no rows; clashing column names do no harm.

    Groups: rows of equal text keep no common shard under this law, as their keys differ; to keep them together, shard by a
    hash of the text (``key_col``).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    spot = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    rows = written(assign(rows, shards, grown).withColumn("spot", spot), "shard-rows")
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / (shards * RANGE_ROWS)))))
    part = F.shiftright(F.conv(F.substring("spot", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("part", part)
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hash range
    before = rows.groupBy("shard", "part").agg(F.sum("n").alias("m")).select("shard", "part", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("spot", F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("own"))
    few = placed.where(F.col("n") == 1)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE_ROWS).cast("long")))
    many = placed.where("n > 1").withColumn("from", chunk).repartition(F.xxhash64("spot", "from"))
    copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RANGE_ROWS, F.col("n")) - 1))
    many = many.withColumn("copy", copy).withColumn("slot", F.col("slot") + F.col("copy"))
    names = ["doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard"]
    return few.select(*names).unionByName(many.select(*names))


def write_shards(docs: DataFrame, path: str, shards: int, key_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet under ``path/shard=0`` ... : whole shards in files of about FILE_BYTES of text.

    A shard's rows are dealt to as many tasks as its bytes need (counted first), by a hash of the row, so that neither a large
    shard nor a repeated key waits for one task. Columns pass through (one named ``shard`` is replaced); a shard without rows has no folder. An
    existing folder raises.
    """
    out = assign(docs, shards, key_col=key_col).drop("grown_shard")
    strings = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in docs.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    size = sum(strings, F.lit(8 * len(docs.columns)))
    files = out.groupBy("shard").agg(F.ceil(F.sum(size.cast("double")) / FILE_BYTES).cast("int").alias("files"))
    found = {r["shard"]: r["files"] for r in files.collect()}  # a number for each shard
    if not found:
        out.write.partitionBy("shard").parquet(path)
        return
    salt, n = fresh("salt", out.columns), F.element_at(F.create_map(*[F.lit(x) for kv in found.items() for x in kv]), F.col("shard"))
    out = out.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not _unhashable(docs, c)]), n))
    tasks = min(sum(found.values()), 100_000)
    out.repartition(tasks, "shard", salt).drop(salt).write.partitionBy("shard").parquet(path)


def _unhashable(docs: DataFrame, name: str) -> bool:
    return "map" in docs.schema[name].dataType.simpleString() or "variant" in docs.schema[name].dataType.simpleString()
