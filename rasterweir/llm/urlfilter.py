"""URL filters by Bloom filter cascades.

The candidate keys of a URL are host suffix + path prefix, the prefixes cut at the lengths that listed rules have. All
candidate keys of the corpus form the key universe. Level 1 of a cascade encodes the listed keys, level 2 the other keys
of the universe that level 1 lets pass, level 3 the listed keys that level 2 lets pass, and so on until none are left. So
every key of the universe gets an exact answer from a few small bit arrays, without a join: the universe meets level 1
in a map, and only what passes is told from the listed keys, by an aggregation. Level 1 has a hash function for each
doubling of universe over list, so that it passes about as many other keys as there are listed ones: all levels are
in proportion to the list, however large the universe is. A list whose levels would be too large to broadcast is cut by
key hash into several cascades, which the pages pass one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, written

#: Least number of hash functions of a level; a level has a bit per key for each hash function, over ln 2.
HASHES = 7
MOST_HASHES = 48
#: Bits of a level for a small list in a large universe: double hashing tells no more keys apart than pairs of positions.
LEAST_BITS = 1 << 20
#: Bytes that a level may have, which is what is broadcast; longer lists are cut into several cascades.
MAX_LEVEL_BYTES = 64 << 20
#: 64-bit words of a bit array that are packed into one row on their way to the driver.
PACK_WORDS = 8_192
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def hashes_for(listed: int, others: int) -> int:
    """Hash functions with which a level passes about as many of the ``others`` as there are ``listed`` keys."""
    return min(MOST_HASHES, max(HASHES, math.ceil(math.log2(max(1.0, others / max(1, listed))))))


def bits_for(listed: int, others: int) -> int:
    """Bits of a level, whole 64-bit words."""
    bits = max(64, listed * hashes_for(listed, others) / math.log(2), min(LEAST_BITS, others))
    return math.ceil(bits / 64) * 64


def _positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    """Bit positions of a key at a level (double hashing of two seeded 64-bit hashes)."""
    a, b = (F.pmod(F.xxhash64(F.lit(2 * level + i), key), F.lit(bits)) for i in (0, 1))
    return F.array(*[F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(hashes)])


@dataclass
class Cascade:
    """Levels as (number of bits, hash functions, packed bits); ``contains`` is exact for keys of the universe it was built over."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def contains(self, positions: list[np.ndarray]) -> np.ndarray:
        """positions: per level an array (keys x hashes). The first level that rejects a key decides."""
        n = len(positions[0]) if positions else 0
        answer = np.full(n, len(self.levels) % 2 == 1)
        open_ = np.ones(n, bool)
        for k, ((_, _, bits), at) in enumerate(zip(self.levels, positions, strict=True)):
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1) if n else open_
            answer[open_ & ~hit] = k % 2 == 1
            open_ &= hit
        return answer


def _level(keys: DataFrame, level: int, others: int) -> tuple[int, int, np.ndarray] | None:
    """The bits of all keys: words are combined map-side and packed PACK_WORDS to a row; what arrives is the array itself."""
    n = keys.count()
    if not n:
        return None
    bits, hashes = bits_for(n, others), hashes_for(n, others)
    at = keys.select(F.explode(_positions(F.col("key"), level, bits, hashes)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part, first = np.zeros(PACK_WORDS, np.int64), int(pdf["word"].iloc[0]) // PACK_WORDS
        part[pdf["word"].to_numpy() % PACK_WORDS] = pdf["value"]
        return pd.DataFrame({"block": [first], "bits": [part.tobytes()]})

    out = np.zeros(-(-bits // 64 // PACK_WORDS) * PACK_WORDS * 8, np.uint8)
    for r in words.groupBy(F.floor(F.col("word") / PACK_WORDS)).applyInPandas(pack, "block long, bits binary").collect():
        out[r["block"] * PACK_WORDS * 8 :][: PACK_WORDS * 8] = np.frombuffer(r["bits"], np.uint8)
    return bits, hashes, out[: bits // 8].copy()


def _tested(keys: DataFrame, level: int, built: tuple[int, int, np.ndarray]) -> DataFrame:
    """Keys that pass a level."""
    bits, hashes, data = built
    shared = keys.sparkSession.sparkContext.broadcast(data)  # at most MAX_LEVEL_BYTES

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                at = np.stack(pdf["at"].to_numpy())
                yield pdf.loc[((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1), ["key"]]

    return keys.select("key", _positions(F.col("key"), level, bits, hashes).alias("at")).mapInPandas(run, "key string")


def build(listed: DataFrame, universe: DataFrame, others: int | None = None, max_levels: int = 60) -> Cascade:
    """A cascade for ``listed(key)`` that is exact over all of ``universe(key)``. Null keys are ignored, repeats do no harm.

    others: about how many keys the universe has; counted if it isn't given.
    """
    own = written(listed.where("key IS NOT NULL").distinct(), "listed")
    out = Cascade()
    others = universe.count() if others is None else others
    if (made := _level(own, 0, others)) is None:
        return out
    out.levels.append(made)
    passed = _tested(universe.where("key IS NOT NULL"), 0, made).withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    sides = [written(passed.groupBy("key").agg(F.max("own").alias("own")).where("NOT own").select("key"), "false-positives"), own]
    for k in range(1, max_levels):
        if (made := _level(sides[0], k, 0)) is None:
            discard(*sides)
            return out
        out.levels.append(made)
        old, sides = sides[1], [written(_tested(sides[1], k, made), "pass"), sides[0]]
        discard(old)
    raise RuntimeError("the cascade did not end")


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes (whole labels) x path prefixes of the given lengths, longest keys first. Empty host: none."""
    if not lengths:
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.array_distinct(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    cuts = F.filter(cuts, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda p: F.concat(s, p))))
    keys = F.array_sort(keys, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url_col: str = "url", default: str = "allow", max_bytes: int = MAX_LEVEL_BYTES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    rules: (key, "allow" or "block"), or a table ``(key, verdict)`` of them; a key is host + path such as ``org/``. A rule
    fits its host and all subdomains if the path starts with the rule's; the longest key wins, of equally long ones the
    block rule, then the first in order. No rule: ``rule`` null and ``default``, what the cascades say of a key in neither
    list. Null URLs and those without ``://`` have empty host and path and fit no rule. A very long URL is read whole.
    Repeated rows are judged alike and all stay; an empty table stays empty. Existing columns with these names are
    replaced, others pass through. A list of any length is exact: beyond ``max_bytes`` a level it is cut by key hash, and
    the pages are written once more per further part. A key without ``/`` and a verdict other than allow and block raise;
    rules with a null key are ignored. The rules' path lengths are prefixes that every URL is cut at: a list of many lengths
    makes many candidate keys.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "key string, verdict string")
    rules = written(rules.where("key IS NOT NULL").select("key", "verdict"), "rules")
    odd = rules.where("instr(key, '/') = 0 OR verdict IS NULL OR verdict NOT IN ('allow', 'block')").first()
    if odd is not None:
        discard(rules)
        raise ValueError(f"neither host + path nor allow or block: {odd['key']!r}, {odd['verdict']!r}")
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    size = F.length("key") - F.instr("key", "/") + 1
    lengths = sorted(r[0] for r in rules.select(size).distinct().collect())
    most = max([r["count"] for r in rules.groupBy("verdict").count().collect()], default=0)
    shard = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))
    # the page's own columns travel as one struct, so that no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = pages.select(row, host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    rows = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = written(rows.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct().select(F.explode(keys).alias("key")).distinct(), "universe")
    others = universe.count()
    # level 1 by list and universe; level 2 has the list's number of keys, give or take; a quarter more for uneven parts
    shards = max(1, math.ceil(1.25 * most * max(hashes_for(most, others), 2 * HASHES) / math.log(2) / 8 / max_bytes))
    for n in range(shards):
        own, every = rules.where(shard(F.col("key")) == n), universe.where(shard(F.col("key")) == n)
        cascades = {v: build(own.where(F.col("verdict") == v).select("key"), every, others // shards) for v in ("allow", "block")}
        here = keys if shards == 1 else F.filter(keys, lambda k: shard(k) == n)  # noqa: B023
        judged = rows.withColumn("keys", here).withColumn("judged", _decided(spark, cascades))
        rows = judged.select("row", "host", "path", "judged.rule", "judged.verdict")
        rows = written(rows, "judged") if n + 1 < shards else rows
    discard(rules, universe)
    return rows.select("row.*", "host", "path", "rule", "verdict")


def _decided(spark: SparkSession, cascades: dict[str, Cascade]) -> Column:
    """``STRUCT<rule, verdict>`` from the columns keys, rule and verdict: the rule so far, or a better one by one pair of cascades."""
    shapes = [(v, k, bits, hashes) for v, c in cascades.items() for k, (bits, hashes, _) in enumerate(c.levels)]
    ends = np.cumsum([0, *[s[3] for s in shapes]])
    at = F.transform("keys", lambda x: F.flatten(F.array(*[_positions(x, k, bits, hashes) for _, k, bits, hashes in shapes]))) if shapes else F.array().cast("array<array<bigint>>")
    shared = spark.sparkContext.broadcast(cascades)  # levels of ``max_bytes`` at most, ever smaller

    def better(old: tuple, new: tuple) -> bool:
        if old[0] is None or len(new[0]) != len(old[0]):
            return old[0] is None or len(new[0]) > len(old[0])
        return new[0] < old[0] if new[1] == old[1] else new[1] == "block"

    @F.pandas_udf("rule string, verdict string")
    def decide(keys: pd.Series, at: pd.Series, rule: pd.Series, verdict: pd.Series) -> pd.DataFrame:
        count = np.array([len(x) for x in keys], np.int64)
        rule, verdict = rule.to_numpy(object, na_value=None).copy(), verdict.to_numpy(object).copy()
        if count.sum() and shapes:
            flat = [k for x in keys for k in x]
            places = np.array([p for x in at for p in x], dtype=np.int64).reshape(len(flat), -1)
            row = np.repeat(np.arange(len(keys)), count)
            for v in ("allow", "block"):
                own = [i for i, s in enumerate(shapes) if s[0] == v]
                if not own:
                    continue
                found = np.flatnonzero(shared.value[v].contains([places[:, ends[i] : ends[i + 1]] for i in own]))
                first, at_first = np.unique(row[found], return_index=True)  # keys are in order: the first is the longest
                for r, j in zip(first, found[at_first], strict=True):
                    if better((rule[r], verdict[r]), (flat[j], v)):
                        rule[r], verdict[r] = flat[j], v
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    # not deterministic for the optimiser: else a filter on the result takes it in, where it can't be evaluated
    return decide.asNondeterministic()("keys", at, "rule", "verdict")
