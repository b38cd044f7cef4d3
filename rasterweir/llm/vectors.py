"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Vectors are normalised; cosine >= t is a Euclidean distance <= r = sqrt(2 - 2t). Equal vectors collapse first. A label of
more vectors than a task takes is divided into cells by coarse centroids, whose number grows with the label; a vector is at
home in its nearest cell and visits the next ones as a query. A cell's members are dealt to blocks, and a task meets two
blocks. It indexes the first: coarse inverted lists, and per list the codes of the residuals with their quantisation
errors. Queries of the second probe the lists nearest to them. The asymmetric distance d(q, code(x)) comes from a
table per query; by the triangle inequality a link has d <= r + error(x), so that test loses no link, and what passes is
reranked by exact cosine in double precision. Links are summed and joined to components inside the task, so what leaves
it is a row per linked vector, not per link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, memory_bytes, written


@dataclass(frozen=True)
class PQParams:
    """cosine: least of a link. cell_rows: vectors that a cell aims at; max_cells: cells of a label at most. visits: cells a
    vector is compared in, its own among them. sample: vectors of a label that its cells are fitted on at most (a bounded
    sample, by hash). block: vectors of one side of a task. list_size: vectors that an inverted list aims at. probes: lists
    of a block that a query visits. subspaces, codes: of the quantiser. rounds: of k-means.
    """

    cosine: float = 0.93
    cell_rows: int = 8_192
    max_cells: int = 4_096
    visits: int = 3
    sample: int = 65_536
    block: int = 8_192
    list_size: int = 256
    probes: int = 8
    subspaces: int = 8
    codes: int = 128
    rounds: int = 6


#: All cells' centroids together are broadcast in so many bytes at most: where they would be more, cells are larger.
CELL_BYTES = 64 << 20
#: The table of blocks per cell is broadcast up to so many bytes (SHAPE_BYTES a row, counted); beyond it, it is joined.
BROADCAST_BYTES = 64 << 20
SHAPE_BYTES = 64
#: Vectors that a quantiser of a block is fitted on at most.
FIT_ROWS = 4_096
#: Queries whose tables are held at a time, and pairs that are reranked at a time.
QUERIES, PAIRS = 1_024, 1 << 15


def _nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest centroids, nearest first; ties by index."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    if k == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's centroids from evenly spread rows; an empty one keeps its place."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds if len(c) < len(x) else 0):
        own = np.concatenate([_nearest(x[i : i + 8192], c)[:, 0] for i in range(0, len(x), 8192)])
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        c[own[order][at]] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return c


class Index:
    """A block of unit vectors: inverted lists around coarse centroids, residual codes per subspace, quantisation errors."""

    def __init__(self, x: np.ndarray, p: PQParams):
        some = x[np.linspace(0, len(x) - 1, min(FIT_ROWS, len(x))).astype(int)]
        self.coarse = kmeans(some, max(1, len(x) // p.list_size), p.rounds)
        self.home = home = _nearest(x, self.coarse)[:, 0]
        rest = x - self.coarse[home]
        edges = np.linspace(0, x.shape[1], min(p.subspaces, x.shape[1]) + 1).astype(int)
        self.cuts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        fit = rest[np.linspace(0, len(x) - 1, min(FIT_ROWS, len(x))).astype(int)]
        self.books = [kmeans(np.ascontiguousarray(fit[:, s]), p.codes, p.rounds) for s in self.cuts]
        code = np.stack([_nearest(rest[:, s], b)[:, 0] for s, b in zip(self.cuts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[code[:, j]] for j, b in enumerate(self.books)], axis=1)
        error = np.sqrt(((rest - back) ** 2).sum(axis=1))
        # |q - c - b|^2 = |q - c|^2 + (2 c b + |b|^2) - 2 q b: the middle belongs to the vector, the last comes from the query's table
        own = (back * (back + 2 * self.coarse[home])).sum(axis=1)
        self.lists = [(m, code[m].T, own[m].astype(np.float32), error[m].astype(np.float32)) for m in (np.flatnonzero(home == k) for k in range(len(self.coarse)))]

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists that each query probes (queries x probes)."""
        return np.concatenate([_nearest(q[a : a + QUERIES], self.coarse, max(2, probes))[:, :probes] for a in range(0, len(q), QUERIES)])

    def search(self, q: np.ndarray, probed: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vector) pairs within the radius by table distance and error, from the lists that a query probes."""
        for a in range(0, len(q), QUERIES):
            part = q[a : a + QUERIES]
            far = np.maximum(0, 1 + (self.coarse**2).sum(1) - 2 * part @ self.coarse.T).astype(np.float32)
            visit = np.zeros(far.shape, bool)
            np.put_along_axis(visit, probed[a : a + QUERIES], True, axis=1)
            tables = [(2 * b @ part[:, s].T).astype(np.float32) for s, b in zip(self.cuts, self.books, strict=True)]  # codes x queries
            for k, (members, code, own, error) in enumerate(self.lists):
                who = np.flatnonzero(visit[:, k])
                if not len(members) or not len(who):
                    continue
                d2 = own[:, None] + far[who, k]
                for t, c in zip(tables, code, strict=True):
                    d2 -= (t if len(who) == len(part) else t[:, who])[c]
                x, y = np.nonzero(d2 <= (((radius + error) ** 2) + 1e-4)[:, None])  # 1e-4: rounding of single precision
                yield a + who[y], members[x]


def _units(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Vectors of length one in double precision."""
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64).reshape(n, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(rows: DataFrame, params: PQParams | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each input row.

    Ids are of any type with an order. Labels of any type are compared as text. Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least ``cosine``. Null or zero vectors, those with null or non-finite components, and those of unlike lengths link
    with nothing, and neither do rows with a null id. Rows that repeat an id are rows of their own that link like any
    others, each by its own vector. ``component_id`` is the smallest id that links reach. Links found are exact; one may be
    missed if neither vector probes the other's list, or neither visits the other's cell. A vector of any length is one
    row. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    p = params or PQParams()
    kind = rows.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    # 128 bits of a vector stand for it wherever rows are only counted or looked up
    base = base.select("vec_id", "label", *[F.when(fine, F.xxhash64(F.lit(i), "vector")).alias(f"h{i}") for i in (1, 2)], F.when(fine, F.col("vector")).alias("vector"))

    # equal vectors collapse, copies within a map task before they are moved; numbered when they are written
    key = ["label", "h1", "h2"]
    reps = base.where("h1 IS NOT NULL").groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), *key, F.size("vector").alias("dim"), "first", "n", "vector"), "vector-reps")

    placed, shape = _placed(reps, p)
    found = written(_searched(placed, shape, kind, p), "links")
    discard(shape, *([placed] if placed is not reps and hasattr(placed, "written_to") else []))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    comp = comp.join(reps.select(F.col("rep").alias("id"), "first"), "id")
    comp = comp.join(comp.groupBy("component").agg(F.min("first").alias("component_id")), "component").select(F.col("id").alias("rep"), "component_id")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    known = reps.select("rep", *key, "first", "n").join(links, "rep", "left").join(comp, "rep", "left")
    known = known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    # narrow rows: adaptive execution splits the partition of a vector that a third of all rows share
    out = base.select("vec_id", *key).join(known, key, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _placed(reps: DataFrame, p: PQParams) -> tuple[DataFrame, DataFrame]:
    """``reps`` with ``home INT`` and ``visits ARRAY<INT>``, and the written ``shape(label, dim, cell, hs, vs)``: blocks of members and of visitors."""
    count = reps.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    width = count.where(F.col("rows") > p.cell_rows).agg(F.sum(F.col("rows") * F.col("dim") * 8)).first()[0] or 0
    cell_rows = max(p.cell_rows, -(-int(width) // CELL_BYTES))
    big = count.where(F.col("rows") > cell_rows)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h1")[: p.sample]
        x = np.stack(pdf["vector"].to_numpy()).astype(float)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        cells = int(min(p.max_cells, -(-pdf["rows"].iloc[0] // cell_rows)))
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": np.int32([x.shape[1]]), "centres": [kmeans(x, cells, p.rounds).ravel()]})

    whole = count.where(F.col("rows") <= cell_rows).select("label", "dim", F.lit(0).alias("cell"), F.col("rows").alias("members"), F.lit(0).cast("long").alias("visitors"))
    placed = reps.withColumns({"home": F.lit(0), "visits": F.array(F.lit(0))})
    if width:
        chosen = reps.join(big, ["label", "dim"]).where(F.pmod("h1", F.lit(1 << 30)) < F.lit(float(1 << 30)) * p.sample / F.col("rows"))
        fitted = chosen.select("label", "dim", "rows", "h1", "vector").groupBy("label", "dim").applyInPandas(fit, "label string, dim int, centres array<double>").toPandas()  # CELL_BYTES at most
        centres = {(r.label, r.dim): np.asarray(r.centres, float).reshape(-1, r.dim) for r in fitted.itertuples()}
        shared = reps.sparkSession.sparkContext.broadcast(centres)

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                label, dim = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("label", "dim"))
                home, visits = np.zeros(b.num_rows, np.int32), [[0]] * b.num_rows
                vector = b.column(b.schema.get_field_index("vector"))
                for k, d in {k for k in zip(label.tolist(), dim.tolist(), strict=True) if k in shared.value}:
                    at = np.flatnonzero((label == k) & (dim == d))
                    near = _nearest(_units(pa.chunked_array([vector.take(pa.array(at))]), len(at)), shared.value[k, d], max(2, p.visits))[:, : p.visits]
                    home[at] = near[:, 0]
                    for i, own in zip(at.tolist(), near.tolist(), strict=True):
                        visits[i] = own
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(visits, pa.list_(pa.int32()))], names=[*b.schema.names, "home", "visits"])

        placed = reps.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema) + ", home int, visits array<int>")
        placed = written(placed, "placed-vectors")  # read several times
        cells = placed.join(big.select("label", "dim"), ["label", "dim"], "left_semi").select("label", "dim", "home", F.explode("visits").alias("cell"))
        inside = F.col("home") == F.col("cell")
        cells = cells.groupBy("label", "dim", "cell").agg(F.count(F.when(inside, 1)).alias("members"), F.count(F.when(~inside, 1)).alias("visitors"))
        whole = whole.unionByName(cells.where("members > 0"))
    blocks = lambda n: F.ceil(F.col(n) / p.block).cast("int")
    return placed, written(whole.select("label", "dim", "cell", blocks("members").alias("hs"), blocks("visitors").alias("vs")), "cells")


def _searched(placed: DataFrame, shape: DataFrame, kind: str, p: PQParams) -> DataFrame:
    """``(rep, n_links, to)`` per task: how many rows a vector links with, and the least vector of its links' component."""
    small = memory_bytes(shape, SHAPE_BYTES) <= BROADCAST_BYTES
    shape = F.broadcast(shape) if small else shape
    cell = ["label", "dim", "cell"]
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    columns = ["rep", "n", "home", "visits", "vector"]
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    # members: every pair of blocks once, then as index of each block of visitors
    mine = placed.withColumn("cell", F.col("home")).join(shape, cell).withColumn("b", spot("hs"))
    pairs = F.transform(upto(F.lit(0), F.col("hs")), lambda k: task(F.least("b", k), F.greatest("b", k), F.when(k < F.col("b"), 1).otherwise(0)))
    guests = F.transform(upto(F.col("hs"), F.col("hs") + F.col("vs")), lambda v: task(F.col("b"), v, 0))
    mine = mine.select(*cell, *columns, F.explode(F.concat(pairs, guests)).alias("t"))
    away = placed.withColumn("cell", F.explode(F.filter("visits", lambda c: c != F.col("home")))).join(shape, cell)
    away = away.withColumn("b", F.col("hs") + spot("vs")).select(*cell, *columns, F.explode(F.transform(upto(F.lit(0), F.col("hs")), lambda k: task(k, F.col("b"), 1))).alias("t"))
    both = mine.unionByName(away).select(*cell, F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.side").alias("side"), *columns)
    radius = float(np.sqrt(max(0.0, 2 - 2 * p.cosine)))

    def search(table: pa.Table) -> pa.Table:
        side, rep, n, home = (table.column(c).to_numpy() for c in ("side", "rep", "n", "home"))
        unit = _units(table.column("vector"), len(side))
        own = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        x = np.flatnonzero(side == 0)
        y = x if own else np.flatnonzero(side == 1)
        count, edges = np.zeros(len(side), np.int64), []
        if len(x) and len(y):
            visits = table.column("visits").to_pylist()
            width = max(map(len, visits))
            visits = np.array([v + [-1] * (width - len(v)) for v in visits])
            at = table.column("cell")[0].as_py()
            index = Index(unit[x], p)
            probed = index.probed(unit[y], p.probes)
            for s, t in index.search(unit[y], probed, radius):
                for b in range(0, len(s), PAIRS):
                    s1, t1 = s[b : b + PAIRS], t[b : b + PAIRS]
                    q, m = y[s1], x[t1]
                    good = (np.einsum("ij,ij->i", unit[q], unit[m]) >= p.cosine) & (q != m)
                    s1, t1, q, m = s1[good], t1[good], q[good], m[good]
                    # a link that its other side finds too, in this block or in the guest's own cell, counts there for that side
                    twice = (probed[t1] == index.home[s1][:, None]).any(axis=1) if own else (home[q] != at) & (visits[m] == home[q][:, None]).any(axis=1)
                    np.add.at(count, q, n[m])
                    np.add.at(count, m[~twice], n[q[~twice]])
                    edges.append((q, m))
        s, t = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (x[:0], x[:0])
        least = rep.copy()
        while True:  # least number over the task's links
            before = least.copy()
            np.minimum.at(least, s, least[t])
            np.minimum.at(least, t, least[s])
            if (least == before).all():
                break
        some = count > 0
        some[s] = some[t] = True
        return pa.table({"rep": rep[some], "n_links": count[some], "to": least[some]})

    return both.groupBy(*cell, "i", "j").applyInArrow(search, "rep long, n_links long, to long")
