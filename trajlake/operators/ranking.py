"""Positions in a global order without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.lineage import cut


def _range_of(value: Column, cuts: list) -> Column:
    """How many cuts are at or below the value, found in two steps of about the root of their number."""
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    arrays = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    group = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups)), lambda x: x <= value))
    inner = F.size(F.filter(F.get(arrays, F.greatest(group - 1, F.lit(0))), lambda x: x <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inner)


def running_sum(rows: DataFrame, number: Column, value: Column, *ties: str, name: str = "upto") -> DataFrame:
    """Adds the sum of a value over each row and all before it, in the order of a number and then ties.  Rows are cut into ranges at
    approximate quantiles (as many numbers as there are shuffle partitions reach the driver), summed within their range, and moved
    up by the sums of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({"__number": number, "__value": value})
    cuts = keyed.agg(F.percentile_approx("__number", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    part = _range_of(F.col("__number"), cuts) if cuts else F.lit(0)
    keyed = keyed.withColumn("__part", part.cast("int"))
    sums = keyed.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy("__part").orderBy("__number", *ties).rowsBetween(Window.unboundedPreceding, 0))
    # at most one row for each range
    summed = keyed.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__own"))
    return summed.drop("__number", "__value", "__part", "__own", "__before")


def positions_within(rows: DataFrame, group: str, number: Column, *ties: str, name: str = "rn") -> DataFrame:
    """Adds each row's place, from 0, within its group, in the order of a number and then ties.  A group with more than two tasks' share
    of the rows (fewer of these than there are shuffle partitions; their names reach the driver) is cut into ranges of the number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(group).agg(F.count("*").alias("__size"))
    total = counts.agg(F.sum("__size").alias("__total"))  # one row
    large = [r[0] for r in counts.crossJoin(F.broadcast(total)).where(F.col("__size") * n > 2 * F.col("__total")).select(group).collect()]
    if not large:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(number, *ties)) - 1).cast("long"))
    own = F.coalesce(F.col(group).isin([x for x in large if x is not None]), F.lit(False)) | (F.col(group).isNull() if None in large else F.lit(False))
    keyed = rows.withColumns({"__number": number, "__large": own})
    cuts = sorted(set(keyed.where("__large").agg(F.percentile_approx("__number", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0] or []))
    part = _range_of(F.col("__number"), cuts) if cuts else F.lit(0)
    keyed = keyed.withColumn("__part", F.when(F.col("__large"), part).otherwise(0).cast("int"))
    sums = keyed.where("__large").groupBy(group, "__part").agg(F.count("*").alias("__sum"))
    upto = F.sum("__sum").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    before = sums.select(F.col(group).alias("__group"), F.col("__part").alias("__range"), (upto - F.col("__sum")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy("__number", *ties)) - 1
    placed = keyed.withColumn("__own", inside).join(F.broadcast(before), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__range")), "left")  # a row for each range of a large group
    return placed.withColumn(name, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__number", "__large", "__part", "__own", "__group", "__range", "__before")


def ordered_positions(rows: DataFrame, *columns: str, name: str = "rn") -> DataFrame:
    """Adds each row's place, from 0, in the order of columns of any kind.  Rows are cut into ranges by samples of them, as a sort does, and
    written with their range; a range's first place is a row of a small table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *columns).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*columns)) - 1
    placed = ranged.withColumn("__inside", inside).join(before, "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__range", "__inside", "__before")


def positions(rows: DataFrame, number: Column, *ties: str, name: str = "rn") -> DataFrame:
    """Adds each row's place, from 0, in the order of a number and then ties."""
    return running_sum(rows, number, F.lit(1).cast("long"), *ties, name=name).withColumn(name, F.col(name) - 1)
