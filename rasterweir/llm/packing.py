"""Best-fit packing of token sequences under several capacities.

Tokenising is map-only; what is packed are pieces of a few integers each. Full pieces are sequences of their own.
The others are dealt by a hash of the piece and its place in the written table to groups of bounded size, so that rows
that repeat go to all groups, and each group is packed by itself:
longest first, into the open bin that fits in every dimension (tokens, documents, attention cost) and for which the
weighted residual that would remain is smallest, or, if asked for, the weighted dot-product of need and room largest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import written

#: Id after each document's own tokens.
SEPARATOR_ID = 0
#: Pieces of a group aim at so many; a group of thousands wastes a fraction of one sequence.
GROUP_PIECES = 6_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weight of each dimension in the score.

    tokens; documents (pieces); attention: sum of the squared lengths of its pieces. ``rule``: "residual" or "dot".
    """

    tokens: int = 2048
    documents: int = 2048
    attention: float = 2048.0**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "residual"


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for whole texts.

    A document's ids are its tokens and a separator. Up to ``limit`` ids are one piece; longer ones are cut into full
    pieces behind a first one that takes the remainder. Null text counts as empty (the separator alone). A null id
    stays null; repeated rows are packed each by itself.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.json_encoder(vocabulary)
        tail = np.array([SEPARATOR_ID], "<u4").tobytes()
        for b in bpe._chunks(batches, "text", 2 * bpe.STEP):
            out: list[tuple] = []
            for doc, packed in zip(b.column(0).to_pylist(), encoder.encode_all([x or "" for x in b.column(1).to_pylist()]), strict=True):
                packed += tail
                n = len(packed) // 4
                first = (n - 1) % limit + 1
                for k, start in enumerate((0, *range(first, n, limit))):
                    length = limit if k else first
                    out.append((doc, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])))
            if out:
                doc, k, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def fit_bins(length: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, for lengths in falling order."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights)
    room = np.empty((len(length), 3))
    name = np.empty(len(length), np.int64)
    bins, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    used, made = 0, 0
    least = float(length[-1]) if len(length) else 0.0
    for i, n in enumerate(length.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        if (need > full).any():
            raise ValueError(f"a piece of {n} ids is over a capacity")
        own = room[:used]
        fits = np.flatnonzero((own[:, 0] >= n) & (own[:, 1] >= 1) & (own[:, 2] >= need[2]))
        if not len(fits):
            j = used
            room[j], name[j] = full, made
            used, made = used + 1, made + 1
        else:
            left = own[fits] / full
            if capacity.rule == "residual":
                j = fits[np.argmin(((left - need / full) ** 2) @ weight)]
            else:
                j = fits[np.argmax((left * (need / full)) @ weight)]
        bins[i], at[i] = name[j], capacity.tokens - room[j, 0]
        room[j] -= need
        if room[j, 0] < least or room[j, 1] < 1 or room[j, 2] < least * least:  # closed: the last open bin takes its place
            used -= 1
            room[j], name[j] = room[used], name[used]
    return bins, at


def pack(docs: DataFrame, vocabulary: str, capacity: Capacity | None = None, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: one row per piece of each document.

    Sequences hold at most what ``capacity`` says, in every dimension; offsets have no gaps. Which piece goes where
    depends on the rows and on where the written pieces lie, so a task that runs again gives the same. Null text is a separator
    alone; ids are integers, strings that aren't numbers raise; repeated rows are packed each by itself, however many there are; a very long text becomes full pieces. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    capacity = capacity or Capacity()
    limit = min(capacity.tokens, int(capacity.attention**0.5))
    found = written(pieces(docs, vocabulary, limit, id_col, text_col), "pieces")
    part = found.where(F.col("length") < limit)
    groups = max(1, -(-part.count() // group_pieces))
    part = part.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, at = fit_bins(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(int(key[0]) + bins * groups) * 2, offset=at)[[*names, "sequence_id", "offset"]]

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = part.groupBy("grp").applyInPandas(run, PIECES + ", sequence_id long, offset long")
    whole = found.where(F.col("length") >= limit).select(*names, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
