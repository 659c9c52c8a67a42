"""Reproducible samples and balanced batches, keyed by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.keyed import draw
from trajlake.operators.ranking import positions


def per_group(rows: DataFrame, group: str, size: int, *order: Column) -> DataFrame:
    """The first `size` rows of each group in an order; a filter on a rank, so that only the first of each task are shuffled."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= size)


def natural(name: Column) -> list[Column]:
    """Whole numbers first, by value; other names after them, by letter."""
    number = name.try_cast("long")
    return [number.isNull(), number, name]


def two_stage(draws: DataFrame, draw_id: str, rows: DataFrame, group: str, key: str, seed: int = 7) -> DataFrame:
    """For each draw a group, all alike, then a row of it.  key: a number below 2 ** 40.  Rows are placed in one order over all groups,
    in which a group is a range, so that a large group is not one task."""
    groups = rows.groupBy(group).agg(F.count("*").alias("size"))
    numbered = groups.withColumn("g", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))  # one row for each group
    placed = positions(rows.select(group, key).join(numbered, group), F.col("g") * (1 << 40) + F.col(key))
    starts = placed.groupBy(group).agg(F.min("rn").alias("start"))
    total = groups.agg(F.count("*").alias("groups"))  # one row
    chosen = draws.crossJoin(F.broadcast(total)).withColumn("g", draw(seed, "group", F.col(draw_id)) % F.col("groups"))
    ranged = chosen.join(numbered.join(starts, group), "g").withColumn("rn", F.col("start") + draw(seed, "row", F.col(draw_id)) % F.col("size"))
    return ranged.select(draw_id, "rn").join(placed.select("rn", group, key), "rn").select(draw_id, group, key)


def weighted_two_stage(draws: DataFrame, draw_id: str, weights: DataFrame, rows: DataFrame, group: str, key: str, seed: int = 7) -> DataFrame:
    """For each draw a group by weight, then a row of it, all alike.  weights: group, weight, one row for each group; a group without
    rows keeps its weight, and its draws come without a row.  key: a number below 2 ** 40."""
    running = Window.orderBy(group)  # one row for each group
    upto = weights.withColumns({"upto": F.sum("weight").over(running.rowsBetween(Window.unboundedPreceding, 0)), "g": F.row_number().over(running) - 1})
    placed = positions(rows.select(group, key).join(upto.select("g", group), group), F.col("g") * (1 << 40) + F.col(key))
    sized = placed.groupBy(group).agg(F.count("*").alias("size"), F.min("rn").alias("start"))
    table = upto.agg(F.array_sort(F.collect_list("upto")).alias("cuts"), F.max("upto").alias("whole"))  # one row
    at = draw(seed, "task", F.col(draw_id)) / F.lit(4294967296.0) * F.col("whole")
    chosen = draws.crossJoin(F.broadcast(table)).withColumn("at", at).select(draw_id, F.size(F.filter("cuts", lambda c: c <= F.col("at"))).alias("g"))
    ranged = chosen.join(upto.select("g", group), "g").join(sized, group, "left")
    return ranged.withColumn("rn", F.col("start") + draw(seed, "row", F.col(draw_id)) % F.col("size")).join(placed.select("rn", key), "rn", "left").select(draw_id, group, key)


def positives(sources: DataFrame, key: str, windows: str, seed: int = 7) -> DataFrame:
    """Sources in hashed order, those without a window left out, each with its place and one of its windows.  windows: a column with
    their number."""
    some = positions(sources.where(F.col(windows) > 0).select(key, windows), draw(seed, "coverage", F.col(key)), key, name="place")
    return some.select("place", key, (draw(seed, "window", F.col("place"), F.col(key)) % F.col(windows)).alias("window"))


def per_split(rows: DataFrame, split: str, group: str, key: str, size: int, seed: int = 7) -> DataFrame:
    """The first `size` rows of each group in hashed order; splits other than clean have a seed of their own."""
    own = F.when(F.col(split) == "clean", F.lit(seed)).otherwise(F.lit(seed + 1_000_003))
    return per_group(rows.withColumn("__set", F.concat_ws("/", split, group)), "__set", size, draw(own, F.col(group), F.col(key)), F.col(key)).drop("__set")


def coverage(rows: DataFrame, key: str, passes: int, half: int, seed: int = 7) -> DataFrame:
    """Every row once in each pass, in another order each time, dealt to batches of `half` rows."""
    each = rows.select(key).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))))
    number = F.col("pass") * 4294967296 + draw(seed, "pass", F.col("pass"), F.col(key))
    placed = positions(each, number, key)
    return placed.select("pass", key, "rn", F.floor(F.col("rn") / half).cast("long").alias("batch_id"))


def other(number: Column, total: Column, *parts: Column | str | int) -> Column:
    """A number below total that is not the given one."""
    return (number + 1 + draw(*parts) % (total - 1)) % total


def balanced(positives: DataFrame, negatives: DataFrame, half: int, seed: int = 7) -> DataFrame:
    """Batches of `half` rows of each label, in hashed order within the batch.  Both sides have columns key and rn (their place, from
    0); batches that lack rows of either label are left out."""
    both = positives.select("key", "rn", F.lit(1).alias("label")).unionByName(negatives.select("key", "rn", F.lit(0).alias("label")))
    dealt = both.withColumn("batch_id", F.floor(F.col("rn") / half).cast("long"))
    full = dealt.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") == 2 * half).select("batch_id")
    order = Window.partitionBy("batch_id").orderBy(draw(seed, "inside", F.col("label"), F.col("key")), "label", "key")  # at most 2 * half rows
    return dealt.join(full, "batch_id", "left_semi").select("batch_id", "label", "key", (F.row_number().over(order) - 1).cast("long").alias("place"))
