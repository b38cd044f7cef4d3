"""Statistics of a corpus that grows: a state per metric and batch that can be stored, merged and read without the images.

A state holds count, mean, sum of squared deviations, least and largest value, and a KLL quantile sketch. Merging states gives
what one pass over all rows gives: the moments up to rounding, quantiles within the sketch's rank error (about 1.33 % for the
default k = 200, half that for each doubling of k), whatever the values' distribution and the order of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: a few hundred values whatever the number of rows.
SKETCH_K = 200
STATE = ["metric", "n", "mean", "m2", "lo", "hi", "sketch"]


def column_values(data: DataFrame, columns: list[str]) -> DataFrame:
    """``(metric, value)`` of numeric columns; nulls and NaN are left out."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]))
    return data.select(values.alias("m")).select("m.*").where("value IS NOT NULL AND NOT isnan(value)")


def feature_values(data: DataFrame, column: str = "features") -> DataFrame:
    """``(metric, value)`` of a vector column, by place (0, 1, ...) as text; nulls and NaN are left out."""
    return data.select(F.posexplode(column).alias("at", "v")).select(F.col("at").cast("string").alias("metric"), F.col("v").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")


def stats_state(values: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """The state of ``values(metric, value)``: STATE, a row per metric. No values: no rows. Aggregated in the tasks before it is moved."""
    return values.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.kll_sketch_agg_double("value", k).alias("sketch"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per metric from any number of states. Deviations are taken from the common mean, so that large means lose no digits."""
    common = states.groupBy("metric").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = states.join(common, "metric").withColumn("m2", F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2))
    return apart.groupBy("metric").agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum("m2").alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def state_quantiles(states: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(metric, share, value)`` from merged states; the least and largest value are exact."""
    def value(s: float) -> Column:  # a share is a constant of the plan
        return F.col("lo") if s <= 0 else F.col("hi") if s >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(s))

    each = F.array(*[F.struct(F.lit(float(s)).alias("share"), value(float(s)).alias("value")) for s in shares])
    return states.select("metric", F.explode(each).alias("q")).select("metric", "q.share", "q.value")


def state_scaler(states: DataFrame) -> DataFrame:
    """``(feature_idx, mu, sigma)`` from merged states of ``feature_values``; a deviation under 1e-8 becomes 1."""
    sigma = F.sqrt(F.col("m2") / F.col("n"))
    return states.select(F.col("metric").cast("int").alias("feature_idx"), F.col("mean").alias("mu"), F.when(sigma < 1e-8, 1.0).otherwise(sigma).alias("sigma"))


def add_batch(values: DataFrame, path: str, batch: str, k: int = SKETCH_K) -> None:
    """Store the state of a batch under its name; storing it again replaces it, so a repeated batch counts once."""
    stats_state(values, k).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def corpus_state(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The merged state of all batches stored below a path."""
    return merged_states(spark.read.parquet(path).select(*STATE))
