"""Connected components of many small and large graphs at once, by aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import dropped, saved


def star_components(edges: DataFrame, group: str = "image_id", max_rounds: int = 60) -> DataFrame:
    """``(group, id, component)`` of ``edges(group, a LONG, b LONG)``: the least id that is reachable within the group.

    One row for each id that has an edge to another; null ends and loops are ignored, repeated edges do no harm. The two star
    operations alternate: every neighbour hooks to the least one seen. A hub is reduced before it is moved, the number
    of edges never grows, and each round is a written table that replaces the one before.
    """
    now = edges.where("a <> b").select(group, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = saved(now, "edges"), None
    for _ in range(max_rounds):
        both = now.union(now.select(group, "v", "u"))
        least = both.groupBy(group, "u").agg(F.min("v").alias("m")).select(group, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, [group, "u"]).select(group, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(group, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [group, "u"]).where("v <> m").select(group, F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, saved(small.union(least.select(group, "u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(old)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64(group, "u", "v")), F.sum(F.xxhash64("v", "u", group).cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(group, F.col("v").alias("id")).distinct()
    return now.select(group, F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select(group, "id", F.col("id").alias("component")))
