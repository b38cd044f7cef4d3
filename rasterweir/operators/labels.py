"""Human labels: seeds, annotation logs, labelled data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import points_in_runs


def negative_seeds(seeds: DataFrame) -> DataFrame:
    """Background, crystal and residue seeds one after the other, duplicates kept."""
    parts = [seeds.where(F.col("kind") == k) for k in ("background", "crystal", "residue")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def seed_votes(seeds: DataFrame, label_runs: DataFrame) -> DataFrame:
    """``(image_id, region_id, pos, neg)``: object seeds and other seeds of the regions that seeds hit.

    Seeds are counted per place before they meet the runs, so a place that a third of all seeds hit is a row.
    """
    places = seeds.groupBy("image_id", "y", "x").agg(F.sum((F.col("kind") == "object").cast("int")).alias("pos"), F.sum((F.col("kind") != "object").cast("int")).alias("neg"))
    return points_in_runs(places, label_runs).groupBy("image_id", "region_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def seed_labels(seeds: DataFrame, label_runs: DataFrame) -> DataFrame:
    """``(image_id, region_id, cls)``: 1 with object seeds only, 0 with other seeds only; regions with both or none are left out.

    Seeds outside the image or on background meet no run.
    """
    votes = seed_votes(seeds, label_runs)
    return votes.where("(pos > 0) <> (neg > 0)").select("image_id", "region_id", (F.col("pos") > 0).cast("int").alias("cls"))


def valid_clicks(events: DataFrame, label_runs: DataFrame) -> DataFrame:
    """Clicks ``(event_id, image_id, y, x)`` that hit a region, with its ``region_id``.

    Places are looked up once each, by one sweep over points and runs, and joined back to their clicks.
    """
    hit = points_in_runs(events.select("image_id", "y", "x").distinct(), label_runs)
    return events.join(hit, ["image_id", "y", "x"]).select("event_id", "image_id", "y", "x", "region_id")


def annotation_replay(log: DataFrame) -> DataFrame:
    """Final ``(session_id, image_id, region_id, cls)`` of ``log(session_id, seq, image_id, action, region_id)``.

    The mode (1 at first) is the session's; a click labels a region with it; undo takes back the last click on that
    image that still stands, and does nothing on an empty history; clear empties an image's labels and history. Clicks
    on region 0 are no clicks. Windows only: a click stands if the history never gets shorter than its place again.
    """
    session = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    image = Window.partitionBy("session_id", "image_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    span = Window.partitionBy("session_id", "image_id", "span").orderBy("seq")
    up, down = span.rowsBetween(Window.unboundedPreceding, 0), span.rowsBetween(0, Window.unboundedFollowing)
    key = F.when(F.col("action") == "mode1", 1).when(F.col("action") == "mode0", 0)
    log = log.withColumn("mode", F.coalesce(F.last(key, ignorenulls=True).over(session), F.lit(1)))
    log = log.where("action = 'clear' OR action = 'undo' OR (action = 'click' AND region_id > 0)")
    log = log.withColumn("span", F.count(F.when(F.col("action") == "clear", 1)).over(image))
    last = log.groupBy("session_id", "image_id").agg(F.max("span").alias("span"))
    log = log.join(last, ["session_id", "image_id", "span"]).where("action <> 'clear'")
    sum_ = F.sum(F.when(F.col("action") == "click", 1).otherwise(-1)).over(up)
    log = log.withColumn("s", sum_)
    log = log.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(up)))
    stands = log.withColumn("stands", F.min("depth").over(down) >= F.col("depth")).where("action = 'click' AND stands")
    return stands.groupBy("session_id", "image_id", "region_id").agg(F.max_by("mode", "seq").alias("cls"))


def class_counts(data: DataFrame, *, check: bool = False) -> DataFrame:
    """``(cls, n)``; with ``check``, fewer than two classes raise."""
    out = data.groupBy("cls").agg(F.count("*").alias("n"))
    if check and out.count() < 2:
        raise ValueError("two classes are needed at least")
    return out


def labelled_dataset(labels: DataFrame, features: DataFrame, *, check: bool = False) -> DataFrame:
    """``(image_id, region_id, features, cls)``: labels joined with the features of their regions.

    Labels of images or regions without features are left out. With ``check``, fewer than two classes raise.
    """
    data = features.join(labels, ["image_id", "region_id"]).select("image_id", "region_id", "features", "cls")
    if check:
        class_counts(data, check=True)
    return data
