"""Spelling variants: words one edit apart, found by comparing dense matrices of code points from both ends.

Two words differ by one inserted, deleted or replaced code point if and only if the length of their common prefix and that of
their common suffix together reach the longer length less one. Blocks of words are held as two padded matrices, one aligned at
the words' beginnings and one at their ends; a comparison of two blocks gives all prefix and suffix lengths at once.

Which blocks meet: of two near words whose longer has m letters, either the first half of m - 1 letters or the last is
common. Words are grouped by (m, leading half) and (m, trailing half). A group of more words than a block is divided in the same
way: g letters of the m - 1 are still open, and half of them must continue the prefix or precede the suffix. When none
is open, all words of a group agree outside one place, so there are no more of them than letters. So no group stays large
and no pair is lost. A pair is reported by one group only: that whose bounds its prefix length keeps.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands its sums on.
FLUSH = 200_000
#: Code points of a text that are cut into runs at a time.
STEP = 1 << 20
#: Words of a group that are compared directly; larger groups are divided.
BLOCK = 256
#: Pairs times letters that one comparison holds at most.
CELLS = 1 << 23
#: Rows of a comparison task that is aimed at.
TILE_ROWS = 20_000
DELETE_EVERY = 199


def runs_of(text: str) -> Iterator[list[str]]:
    """Maximal runs of letters, A-Z in lower case, a list for about STEP code points."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and RUN.match(text, end - 1, end) and RUN.match(text, end, end + 1):
            end += 1  # not inside a run
        part = text[at:end]
        yield RUN.findall(part.lower() if part.isascii() else part.encode("utf-8", "replace").lower().decode("utf-8"))
        at = end


def typo(doc_id: str, run: str) -> str:
    """The run as it counts: every DELETE_EVERY-th (by a checksum of document and run) lacks one code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "replace"))
    return run if h % DELETE_EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``(word, n)``: the distinct results of ``typo`` over all runs of all texts, with their occurrences.

    Words below ``least_length`` code points or ``least_count`` occurrences are left out. Null and empty texts have no runs; a
    null id is the empty one. Counts are summed in the tasks before they are moved, so a frequent word is as cheap as a rare one.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                doc = i.as_py()
                for found in runs_of(text.as_py()):
                    for run, n in Counter(found).items():
                        if len(run) >= least_length:  # a run never grows
                            sums[typo(doc, run)] += n
                if len(sums) > FLUSH:
                    yield out()
                    sums.clear()
        yield out()

    found = rows.mapInArrow(count, "word string, n long").where(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words aligned at their beginnings, at their ends (0 is padding), and their lengths."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row, start = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size) - size, size)
    col = np.arange(len(flat)) - start
    head = np.zeros((len(words), int(size.max(initial=0))), np.uint32)
    tail = head.copy()
    head[row, col] = flat
    tail[row, size[row] - 1 - col] = flat
    return head, tail, size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters before the first difference, pair by pair along the last axis; the whole width if there is none."""
    differ = a != b
    return np.where(differ.any(axis=-1), differ.argmax(axis=-1), a.shape[-1])


def near_pairs(words: list[str], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, prefix)``: pairs of one group that are one edit apart, each once, with the length of their common prefix.

    ``starts``: first index of each group; groups are contiguous. Groups of about one size (the next power of two) are stacked,
    and a tile compares whole groups with themselves: groups x words x words x letters, CELLS at most, or one row of words. Equal words are never near.
    """
    head, tail, size = matrices(words)
    starts = np.asarray(starts, np.int64)
    count = np.diff(np.append(starts, len(words)))
    width = max(1, head.shape[1])
    for k in (1 << e for e in range(1, int(count.max(initial=1)).bit_length() + 1)):
        of_size = starts[(count > k // 2) & (count <= k) & (count > 1)], count[(count > k // 2) & (count <= k) & (count > 1)]
        groups = max(1, CELLS // (k * k * width))
        rows = k if groups > 1 else max(1, min(k, CELLS // (k * width)))
        for g in range(0, len(of_size[0]), groups):
            at = of_size[0][g : g + groups, None] + np.arange(k)
            held = np.arange(k) < of_size[1][g : g + groups, None]
            at = np.where(held, at, 0)
            for r in range(0, k, rows):
                i, j = at[:, r : r + rows, None], at[:, None, :]
                prefix = _common(head[i], head[j])
                suffix = _common(tail[i], tail[j])
                most, least = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])
                prefix, suffix = np.minimum(prefix, least), np.minimum(suffix, least)
                good = (prefix + suffix >= most - 1) & (most - least <= 1) & ~((most == least) & (prefix == most))
                good &= held[:, r : r + rows, None] & held[:, None, :] & (i < j)
                x, y, z = np.nonzero(good)
                yield at[x, y + r], at[x, z], prefix[x, y, z]


#: What tells groups apart besides the shared letters; two ways of dividing may lead to one p and s, with other bounds.
GROUP = ["key", "m", "p", "s", "below"]


def _grouped(m: Column, p: Column, s: Column, below: Column) -> Column:
    """Key of the words that share their first ``p`` and last ``s`` letters."""
    return F.xxhash64(m, p, s, below, F.expr("substring(word, 1, p)"), F.expr("substring(word, char_length(word) - s + 1, s)"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _grouped(F.col("m"), F.col("p"), F.col("s"), F.col("below")))


def near_words(words: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of distinct words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    ``words(word)`` without repetitions; null and empty words have no partner. Very long words make narrow tiles.
    """
    base = words.select("word").where("word IS NOT NULL AND word <> ''").withColumn("len", F.char_length("word"))
    base = base.withColumn("m", F.explode(F.array("len", F.col("len") + 1)))
    half = F.ceil((F.col("m") - 1) / 2).cast("int")
    zero, none = F.lit(0), F.col("m")
    # p, s: letters that are common; open below: prefixes of pairs are shorter than this
    sides = F.array(F.struct(half.alias("p"), zero.alias("s"), none.alias("below")), F.struct(zero.alias("p"), half.alias("s"), half.alias("below")))
    rows = _keyed(base.withColumn("side", F.explode(sides)).select("word", "len", "m", "side.*"))
    done: list[DataFrame] = []
    while True:
        rows = written(rows, "spelling-groups")
        sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("size"), F.max(F.col("len") == F.col("m")).alias("whole")).where("size > 1 AND whole")
        met = written(rows.join(sizes.drop("whole"), GROUP), "spelling-met")
        discard(rows)
        open_letters = F.col("m") - 1 - F.col("p") - F.col("s")
        large = (F.col("size") > BLOCK) & (open_letters > 0)
        done.append(met)
        rest = met.where(large)
        if rest.isEmpty():
            break
        step = F.ceil(open_letters / 2).cast("int")
        first = F.struct((F.col("p") + step).alias("p"), F.col("s").alias("s"), F.col("below").alias("below"))
        second = F.struct(F.col("p").alias("p"), (F.col("s") + step).alias("s"), F.least("below", F.col("p") + step).alias("below"))
        rows = _keyed(rest.withColumn("side", F.explode(F.array(first, second))).select("word", "len", "m", "side.*"))
    links = [_compared(met.where(~((F.col("size") > BLOCK) & (F.col("m") - 1 - F.col("p") - F.col("s") > 0)))) for met in done]
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    out = written(out, "spelling-links")
    discard(*done)
    return out


def _compared(met: DataFrame) -> DataFrame:
    """Pairs of the groups, whole groups dealt to tiles of about TILE_ROWS rows."""
    tiles = max(1, math.ceil(met.count() / TILE_ROWS))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m", "key", "p", "s", "below"], kind="stable")
        ident = pdf[["m", "key", "p", "s", "below"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (ident[1:] != ident[:-1]).any(axis=1)))
        word, size, below, m = pdf["word"].to_numpy(), pdf["len"].to_numpy(), pdf["below"].to_numpy(), pdf["m"].to_numpy()
        a, b = [word[:0]], [word[:0]]
        ends = np.append(starts[1:], len(pdf))
        at = 0
        while at < len(starts):  # groups of about one length, so that a long word doesn't widen the others' matrices
            to = at + 1
            while to < len(starts) and int(m[starts[to]]).bit_length() == int(m[starts[at]]).bit_length() and (ends[to] - starts[at]) * int(m[starts[to]]) <= CELLS:
                to += 1
            first = starts[at]
            for i, j, prefix in near_pairs(list(word[first : ends[to - 1]]), starts[at:to] - first):
                i, j = i + first, j + first
                ok = (np.maximum(size[i], size[j]) == m[i]) & (prefix < below[i])  # this group's pairs, not another's
                a.append(word[i[ok]])
                b.append(word[j[ok]])
            at = to
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}, dtype=object)

    return met.withColumn("tile", F.pmod("key", F.lit(tiles))).groupBy("tile").applyInPandas(compare, "a string, b string")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: one row for each word of ``word_counts``.

    form: the near word of most occurrences, ties to the first in code-point order, if it occurs ``factor`` times as often at
    least; else null. root: the end of the chain of forms, the word itself if it has none. n_near: near words, 0 if none. Occurrences
    grow by ``factor`` along a chain, which bounds the rounds of doubling. An empty table gives no rows; repeated rows count
    each; columns of other names aren't read.
    """
    words = written(word_counts(docs, id_col, text_col, least_length, least_count), "words")
    links = near_words(words)
    both = links.union(links.select("b", "a")).toDF("word", "near")
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(F.negative("near_n").alias("k"), F.col("near"))).alias("best"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), F.negative("best.k").alias("form_n"))
    good = F.col("form_n") >= factor * F.col("n")
    out = written(out.withColumns({"form": F.when(good, F.col("form")), "form_n": F.when(good, F.col("form_n"))}), "forms")
    most = out.agg(F.max("n")).first()[0] or 1
    jumps = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log(most, factor) + 1))))):
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        jumps = written(jumps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
    out = out.join(jumps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
