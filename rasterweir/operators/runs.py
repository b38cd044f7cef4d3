"""Masks as horizontal runs ``(image_id, y, x0, x1)``: set operations, points in runs, components over strips, holes.

Nothing here unfolds a run to its pixels, so rows are in proportion to runs. Windows go over one row of one image; what
they hold is bounded by the image's width, however many images, regions, points or annotators there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import dropped, saved
from .graph import star_components

RUN = ["image_id", "y", "x0", "x1"]
#: Rows of a strip in which components are labelled by one task.
STRIP = 256


def mask_runs(pixels: DataFrame) -> DataFrame:
    """The set pixels ``(image_id, y, x)`` as maximal runs; repeated pixels count once. Neighbours in a row share x minus their rank."""
    rank = F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    cut = pixels.select("image_id", "y", "x").distinct().withColumn("g", F.col("x") - rank)
    return cut.groupBy("image_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select(*RUN)


def _bounds(runs: DataFrame, side: str) -> DataFrame:
    """Where runs begin (+1) and end (-1), summed per place."""
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("step")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("step"))))
    rows = runs.where("x0 < x1").select("image_id", "y", ends.alias("e"))
    return rows.select("image_id", "y", F.col("e.x").alias("x"), *[(F.col("e.step") if s == side else F.lit(0)).alias(s) for s in ("a", "b")])


def run_algebra(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Maximal runs of ``a and b``, ``a or b`` or ``a minus b`` (``how``) by one sweep over the places where runs begin or end.

    Runs of a side may touch, overlap or repeat; empty ones count for nothing. Any other ``how`` raises.
    """
    inside = {"and": lambda x, y: x & y, "or": lambda x, y: x | y, "minus": lambda x, y: x & ~y}
    if how not in inside:
        raise ValueError(f"unknown operation {how}")
    places = _bounds(a, "a").unionByName(_bounds(b, "b")).groupBy("image_id", "y", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = Window.partitionBy("image_id", "y").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    on = inside[how](F.sum("a").over(upto) > 0, F.sum("b").over(upto) > 0)
    turns = places.select("image_id", "y", "x", on.alias("on")).withColumn("was", F.coalesce(F.lag("on").over(row), F.lit(False))).where("on <> was")
    return turns.withColumn("x1", F.lead("x").over(row)).where("on").select("image_id", "y", F.col("x").alias("x0"), "x1")


def frame_runs(sizes: DataFrame) -> DataFrame:
    """A run for every row of the images ``sizes(image_id, height, width)``."""
    rows = sizes.where("height > 0 AND width > 0").select("image_id", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("y"), "width")
    return rows.select("image_id", "y", F.lit(0).alias("x0"), F.col("width").cast("int").alias("x1"))


def complement(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of the pixels of the images that are in no run; an image without runs is its whole frame."""
    return run_algebra(frame_runs(sizes), runs, "minus")


def points_in_runs(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points`` that lie in a run, with the run's ``region_id``; runs of a row mustn't overlap. Each point's place is one row.

    ``points(image_id, y, x, ...)`` has each place once. Points and the runs' beginnings are put in one order, and a point
    gets the last run that began, if that hasn't ended yet: work is linear in points and runs, whatever the runs' lengths.
    """
    rest = [c for c in points.columns if c not in ("image_id", "y", "x")]
    begun = runs.where("x0 < x1").select("image_id", "y", F.col("x0").alias("x"), F.struct("x1", "region_id").alias("_run"), F.lit(None).alias("_point"), F.lit(0).alias("_last"))
    asked = points.select("image_id", "y", "x", F.lit(None).alias("_run"), F.struct(F.lit(True).alias("is"), *rest).alias("_point"), F.lit(1).alias("_last"))
    row = Window.partitionBy("image_id", "y").orderBy("x", "_last").rowsBetween(Window.unboundedPreceding, 0)
    met = begun.unionByName(asked).withColumn("_run", F.last("_run", ignorenulls=True).over(row)).where("_point.is AND x < _run.x1")
    return met.select("image_id", "y", "x", *[F.col("_point")[c].alias(c) for c in rest], F.col("_run.region_id").alias("region_id"))


def _labelled(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """Numbers of the components of runs in the order (y, x0), each the index of its first run."""
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    begin = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(y) else np.zeros(0, int)
    end = np.append(begin[1:], len(y))
    for k in range(1, len(begin)):
        i, j = begin[k - 1], begin[k]
        while y[begin[k]] == y[begin[k - 1]] + 1 and i < end[k - 1] and j < end[k]:
            if x0[i] < x1[j] + reach and x0[j] < x1[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return np.array([root(i) for i in range(len(y))], np.int64)


def _seams(rows: DataFrame, strip: int, reach: int) -> DataFrame:
    """``(image_id, a, b)``: nodes of runs that touch across the border of two strips.

    The runs of a row don't overlap, so of two that touch the later one meets the last run of the other side that has begun.
    """
    place = F.pmod("y", F.lit(strip))
    lower = rows.where(place == 0).select("image_id", F.col("y").alias("seam"), "x0", "x1", "node", F.lit(1).alias("side"))
    upper = rows.where(place == strip - 1).select("image_id", (F.col("y") + 1).alias("seam"), "x0", "x1", "node", F.lit(0).alias("side"))
    row = Window.partitionBy("image_id", "seam").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct("x1", "node")
    both = upper.unionByName(lower).withColumns({f"_{s}": F.last(F.when(F.col("side") == s, own), ignorenulls=True).over(row) for s in (0, 1)})
    other: Column = F.when(F.col("side") == 0, F.col("_1")).otherwise(F.col("_0"))
    met = both.withColumn("other", other).where(F.col("x0") < F.col("other.x1") + reach)
    return met.select("image_id", F.col("node").alias("a"), F.col("other.node").alias("b")).distinct()


def run_components(runs: DataFrame, connectivity: int = 8, strip: int = STRIP) -> DataFrame:
    """``label_runs(image_id, region_id, y, x0, x1)`` of disjoint maximal runs; ids count from 1 by first pixel in row order.

    An image is cut into strips of ``strip`` rows. A task labels the runs of one strip; components of strips are joined by the runs that
    touch across their borders, as a graph whose edges are those seams only; ids are counted per strip and then offset. So no
    task sees an image, and an image of any height is dealt over the cluster. Labels don't depend on ``strip``.
    """
    if connectivity not in (4, 8) or strip < 1:
        raise ValueError("connectivity is 4 or 8, and a strip has a row at least")
    reach = 1 if connectivity == 8 else 0
    kind = runs.schema["image_id"].dataType.simpleString()

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"], kind="stable")
        y, x0, x1 = (pdf[c].to_numpy() for c in ("y", "x0", "x1"))
        first = _labelled(y, x0, x1, reach)
        node = (np.int64(y[0] // strip) << np.int64(32)) + first  # less than 2 ** 32 runs in a strip
        return pd.DataFrame({"image_id": pdf["image_id"], "y": y, "x0": x0, "x1": x1, "node": node, "y_first": y[first], "x_first": x0[first]})

    cut = runs.select(*RUN).withColumn("strip", F.floor(F.col("y") / strip))
    rows = saved(cut.groupBy("image_id", "strip").applyInPandas(label, f"image_id {kind}, y int, x0 int, x1 int, node long, y_first int, x_first int"), "strips")
    joined = star_components(_seams(rows, strip, reach))
    nodes = rows.select("image_id", "node", "y_first", "x_first").distinct().join(joined.withColumnRenamed("id", "node"), ["image_id", "node"], "left")
    nodes = saved(nodes.withColumn("component", F.coalesce("component", "node")), "nodes")
    firsts = nodes.groupBy("image_id", "component").agg(F.min(F.struct("y_first", "x_first")).alias("at")).withColumn("strip", F.floor(F.col("at.y_first") / strip))
    before = Window.partitionBy("image_id").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)  # a row per strip
    offsets = firsts.groupBy("image_id", "strip").agg(F.count("*").alias("n")).select("image_id", "strip", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("image_id", "strip").orderBy("at"))
    ids = firsts.withColumn("rank", rank).join(offsets, ["image_id", "strip"]).select("image_id", "component", (F.col("rank") + F.col("offset")).cast("int").alias("region_id"))
    out = rows.join(nodes.select("image_id", "node", "component"), ["image_id", "node"]).join(ids, ["image_id", "component"])
    out = saved(out.select("image_id", "region_id", "y", "x0", "x1"), "label-runs")
    dropped(rows, nodes)
    return out


def run_fill_holes(runs: DataFrame, sizes: DataFrame, strip: int = STRIP) -> DataFrame:
    """``runs`` and the background of their images that isn't 4-connected to the background pixel at (0, 0), as maximal runs.

    Where that pixel is set, all background is a hole. Components of the complement's runs, so no image is unfolded or seen whole.
    """
    outside = run_components(complement(runs, sizes), 4, strip)
    corner = outside.where("y = 0 AND x0 = 0").select("image_id", "region_id")
    return run_algebra(runs, outside.join(corner, ["image_id", "region_id"], "left_anti"), "or")
