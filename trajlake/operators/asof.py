"""The nearest row in an order, however far: events and points are put in one order, and each point looks at the last event before it and
the first after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.ranking import _range_of


def nearest(points: DataFrame, events: DataFrame, group: str, at: str, when: str, tie: str, columns: list[str]) -> DataFrame:
    """Points with off, and `columns` of the event of their group whose number `when` is nearest to `at`; of events equally near the one
    with the least `tie`.  A group without events gives nulls.

    Events and points are cut into ranges at quantiles of their numbers (as many as there are shuffle partitions reach the driver), so a
    group that holds most rows is several tasks; what a range carries over to the next ones is a row for each range and group.  A
    group or number that is null meets nothing."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = F.struct(F.col(when).alias("when"), F.col(tie).alias("tie"), *(F.col(c).alias(c) for c in columns))
    # of events at one number the least counts
    single = events.where(F.col(group).isNotNull() & F.col(when).isNotNull()).groupBy(F.col(group).alias("g"), F.col(when).alias("x")).agg(F.min_by(held, F.col(tie)).alias("event"))
    kind = single.schema["event"].dataType
    asked = points.select(F.col(group).alias("g"), F.col(at).alias("x"), F.lit(None).cast(kind).alias("event"), F.struct(*points.columns).alias("point"))
    both = single.withColumn("point", F.lit(None).cast(asked.schema["point"].dataType)).unionByName(asked)
    cuts = sorted(set(both.agg(F.percentile_approx("x", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0] or []))
    ranged = both.withColumn("part", (_range_of(F.col("x"), cuts) if cuts else F.lit(0)).cast("int"))
    ends = ranged.groupBy("g", "part").agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("x"))).alias("last"), F.min_by("event", F.when(F.col("event").isNotNull(), F.col("x"))).alias("first"))
    over = Window.partitionBy("g").orderBy("part")  # a row for each range
    carried = ends.select("g", "part", F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inside = Window.partitionBy("g", "part").orderBy("x", F.col("event").isNull())
    low = F.last("event", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("event", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    placed = ranged.withColumns({"low": low, "high": high}).where("point is not null")
    met = placed.join(carried, ["g", "part"], "left").withColumns({"low": F.coalesce("low", "before"), "high": F.coalesce("high", "after")})
    down, up = F.col("x") - F.col("low.when"), F.col("high.when") - F.col("x")
    lower = F.col("high").isNull() | (down < up) | (down == up) & (F.col("low.tie") <= F.col("high.tie"))
    best = F.when(F.col("low").isNotNull() & lower, F.col("low")).otherwise(F.col("high"))
    found = met.withColumn("best", F.when(F.col("g").isNotNull() & F.col("x").isNotNull(), best))
    return found.select("point.*", F.abs(F.col("best.when") - F.col("x")).alias("off"), *(F.col(f"best.{c}").alias(c) for c in columns))
