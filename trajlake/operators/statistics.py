"""Statistics by dimension; partial and final aggregation is the engine's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.lineage import cut


def by_dimension(vectors: DataFrame, column: str, *keep: str) -> DataFrame:
    """dim, x: one row per value."""
    return vectors.select(*keep, F.posexplode(column).alias("dim", "x")).select(*keep, F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


def spread(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))


def moments(values: DataFrame, *by: str) -> DataFrame:
    """n, mean, and population standard deviation."""
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def partial_moments(values: DataFrame, *by: str) -> DataFrame:
    """n, mean, m2, low, high: what can be kept and merged later."""
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"))


def merged_moments(partials: DataFrame, *by: str) -> DataFrame:
    """Of stored partials: the squares of each add up, and so do those of their means around the mean of all, which is taken first, so
    that nothing large cancels out."""
    whole = partials.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = partials.select(*by, F.col("n").alias("own"), F.col("mean").alias("at"), "m2").join(whole, list(by))
    around = F.sum(F.col("m2") + F.col("own") * F.pow(F.col("at") - F.col("mean"), 2))
    return each.groupBy(*by, "n", "mean", "low", "high").agg(F.sqrt(around / F.col("n")).alias("std"))


def histogram_quantiles(values: DataFrame, shares: list[float], bins: int, by: str = "dim") -> DataFrame:
    """Two passes: the range of each dimension, then counts of bins.  The bin of x is floor((x - low) * (bins - 1) / range); the value of
    a bin is its left edge on a grid of `bins` bins over the range, which lies below the true quantile by up to two bins.  By dimension
    the values are not shuffled: what is broadcast has a row for each.  By another column the ranges are written first, so that Spark
    knows their size and broadcasts them only where it is small."""
    ranges = values.groupBy(by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("total"))
    scaled = F.floor((F.col("x") - F.col("low")) * ((bins - 1) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))))
    binned = values.join(F.broadcast(ranges) if by == "dim" else cut(ranges, "ranges"), by).select(by, "low", "high", "total", F.least(F.greatest(scaled, F.lit(0)), F.lit(bins - 1)).alias("bin"))
    counted = binned.groupBy(by, "low", "high", "total", "bin").agg(F.count("*").alias("k"))
    running = counted.withColumn("upto", F.sum("k").over(Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    found = [F.min(F.when(F.col("upto") >= F.col("total") * s, F.col("bin"))).alias(f"b{i}") for i, s in enumerate(shares)]
    low, high = F.col("low") - 1e-12, F.col("high") + 1e-12
    edges = [(low + F.col(f"b{i}") * ((high - low) / bins)).alias(f"q{round(100 * s):02d}") for i, s in enumerate(shares)]
    return running.groupBy(by, "low", "high").agg(*found).select(by, *edges)


def beyond(values: DataFrame, limit: float, *by: str) -> DataFrame:
    """Of each group: its greatest absolute value, how many dimensions go beyond the limit, and which."""
    size = F.abs("x")
    dims = F.array_sort(F.collect_set(F.when(size > limit, F.col("dim"))))
    return values.groupBy(*by).agg(F.max(size).alias("max_abs"), F.size(dims).cast("long").alias("n_dims"), F.array_join(F.transform(dims, lambda d: d.cast("string")), ",").alias("dims"))


def agreement(counts: list[Column]) -> Column:
    """All counts that are not 0 are equal, and there is one."""
    return F.size(F.array_distinct(F.filter(F.array(*counts), lambda x: x > 0))) == 1
