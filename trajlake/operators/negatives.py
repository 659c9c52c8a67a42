"""Corruptions of action matrices, labelled 0; all act on array columns of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.keyed import draw
from trajlake.functions.vectors import negate_places, swap
from trajlake.operators.lineage import cut
from trajlake.operators.ranking import positions

KINDS = ("time_swap", "joint_swap", "flip_gripper", "half_noise", "swap_between_samples")
GRIPPERS = (6, 13)


def time_swap(rows: Column, steps: int, key: Column, seed: int = 7, times: int = 2) -> Column:
    """Two steps change places, `times` times; equal draws change nothing."""
    for k in range(times):
        a, b = (draw(seed, "time", k, side, key) % steps for side in ("a", "b"))
        rows = swap(rows, a, b)
    return rows


def free_dims(width: int, avoid: tuple[int, ...] = GRIPPERS) -> list[int]:
    return [d for d in range(width) if d not in avoid]


def free_dims_of(width: Column, avoid: Column) -> Column:
    """The same for each row: its dimensions but for those of a list."""
    return F.array_except(F.sequence(F.lit(0), width - 1), avoid)


def joint_swap(rows: Column, steps: int, width: int, key: Column, seed: int = 7, times: int = 3, avoid: tuple[int, ...] = GRIPPERS) -> Column:
    """At a step, two of the dimensions not avoided change places, `times` times."""
    dims = free_dims(width, avoid)
    if len(dims) < 2:
        return rows
    free = F.array(*map(F.lit, dims))
    for k in range(times):
        at, a = draw(seed, "step", k, key) % steps, draw(seed, "from", k, key) % len(dims)
        b = (a + 1 + draw(seed, "to", k, key) % (len(dims) - 1)) % len(dims)
        rows = F.transform(rows, lambda row, t: F.when(t == at, swap(row, F.get(free, a.cast("int")), F.get(free, b.cast("int")))).otherwise(row))
    return rows


def flip(rows: Column, places: tuple[int, ...] = GRIPPERS) -> Column:
    return F.transform(rows, lambda row: negate_places(row, places))


def half_noise(rows: Column, steps: int, key: Column, seed: int = 7, scale: float = 0.5) -> Column:
    """Normal noise on the second half of the steps: of two draws each, by Box and Muller."""

    def noise(t: Column, d: Column) -> Column:
        u, v = ((draw(seed, side, key, t, d) + 1) / 4294967297.0 for side in ("u", "v"))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)

    return F.transform(rows, lambda row, t: F.when(t >= steps // 2, F.transform(row, lambda x, d: x + scale * noise(t, d))).otherwise(row))


def pairs(rows: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """key, partner: neighbours in hashed order, both ways; the last of an odd number has none."""
    placed = positions(rows.select(key), draw(seed, "pair", F.col(key)), key)
    two = placed.select(F.floor(F.col("rn") / 2).alias("pair"), key)
    return two.join(two.select("pair", F.col(key).alias("partner")), "pair").where(F.col(key) != F.col("partner")).select(key, "partner")


def fan_out(rows: DataFrame, key: str, task: str, actions: str, steps: int, width: int, seed: int = 7) -> DataFrame:
    """Negatives of samples: key, neg_type, label 0, task, partner and its task, actions, tokens.  Four corruptions of each sample's own
    actions, and for each that has a partner the partner's actions; tokens are always the sample's own (here its matrix)."""
    own, at = F.col(actions), F.col(key)
    made = {"time_swap": time_swap(own, steps, at, seed), "joint_swap": joint_swap(own, steps, width, at, seed), "flip_gripper": flip(own), "half_noise": half_noise(own, steps, at, seed)}
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("neg_type"), m.alias("actions")) for k, m in made.items())))
    held = rows.select(key, F.col(task).alias("task"), own.alias("tokens"))
    corrupted = rows.select(key, F.col(task).alias("task"), own.alias("tokens"), each).withColumns({"partner": F.lit(None).cast("long"), "partner_task": F.lit(None).cast(rows.schema[task].dataType)})
    others = rows.select(at.alias("partner"), F.col(task).alias("partner_task"), own.alias("actions"))
    swapped = pairs(rows, key, seed).join(held, key).join(others, "partner").withColumn("neg_type", F.lit("swap_between_samples"))
    columns = [key, "neg_type", F.lit(0).alias("label"), "task", "partner", "partner_task", "actions", "tokens"]
    return corrupted.select(*columns).unionByName(swapped.select(*columns))


def _wide(sided: DataFrame) -> DataFrame:
    """a, at, b, bt: the two keys of each pair with their tasks.  sided: pair, side (0 or 1), key, task."""
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return sided.groupBy("pair").agg(of(0, "key").alias("a"), of(0, "task").alias("at"), of(1, "key").alias("b"), of(1, "task").alias("bt")).drop("pair")


def _even(placed: DataFrame) -> DataFrame:
    """Adds half of the number of rows, which come in order of rn, without the last of an odd number."""
    half = placed.agg(F.floor(F.count("*") / 2).alias("half"))  # one row
    return placed.crossJoin(F.broadcast(half)).where(F.col("rn") < 2 * F.col("half"))


def pairs_across(rows: DataFrame, key: str, task: str, seed: int = 7) -> DataFrame:
    """key, partner, task, partner_task: a random matching in which as many pairs as can be are of two tasks; the last of an odd number in
    hashed order has none.  (Null is a task.)

    1. Neighbours in hashed order are paired, as if tasks did not matter; pairs of two tasks stay.
    2. The rows of the others are sorted by task and paired half a table apart: their tasks differ unless one has more than half.
    3. What is still of one task, then all of it the same, exchanges partners with pairs that do not have it: (x, x) and (y, z) become
       (x, y) and (x, z).  Pairs left over after that would have to be made of rows of no other task: all other rows are taken.

    Each step joins places in an order of ranges, so no task sees all rows of a task, and what a step has done is written first."""
    tasks = rows.groupBy(F.col(task).alias("task")).agg(F.count("*").alias("n"))
    numbered = tasks.select("task", (F.row_number().over(Window.orderBy("task")) - 1).cast("long").alias("g"))  # a row for each task
    own = cut(rows.select(F.col(key).alias("key"), F.col(task).alias("t")).join(numbered, F.col("t").eqNullSafe(F.col("task"))).select("key", F.col("g").alias("task")), "rows")
    first = _even(positions(own, draw(seed, "pair", F.col("key")), "key"))
    first = cut(_wide(first.select(F.floor(F.col("rn") / 2).alias("pair"), (F.col("rn") % 2).alias("side"), "key", "task")), "first")
    same = F.col("at") == F.col("bt")
    pool = first.where(same).select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("at").alias("task")), F.struct(F.col("b").alias("key"), F.col("bt").alias("task")))).alias("r")).select("r.*")
    second = _even(positions(pool, F.col("task") * F.lit(4294967296.0) + draw(seed, "pool", F.col("key")), "key"))
    second = cut(_wide(second.select((F.col("rn") % F.col("half")).alias("pair"), F.floor(F.col("rn") / F.col("half")).alias("side"), "key", "task")), "second")
    done = first.where(~same).unionByName(second.where(~same))
    left = positions(second.where(same), draw(seed, "left", F.col("a")), "a")
    whose = second.where(same).agg(F.max("at").alias("whose"))  # one row; null if nothing is left
    able = done.crossJoin(F.broadcast(whose)).withColumn("able", F.coalesce((F.col("at") != F.col("whose")) & (F.col("bt") != F.col("whose")), F.lit(False))).drop("whose")
    givers = positions(able.where("able").drop("able"), draw(seed, "giver", F.col("a")), "a").select("rn", F.struct("a", "at", "b", "bt").alias("y"))
    met = left.select("rn", F.struct("a", "at", "b", "bt").alias("x")).join(givers, "rn", "full")
    pair = lambda p, q: F.struct(p[0].alias("a"), p[1].alias("at"), q[0].alias("b"), q[1].alias("bt"))
    side = lambda c, k: (F.col(c)[k], F.col(c)[f"{k}t"])
    crossed = F.array(pair(side("x", "a"), side("y", "a")), pair(side("x", "b"), side("y", "b")))
    both = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), crossed).otherwise(F.array(F.coalesce("x", "y")))
    out = able.where("not able").drop("able").unionByName(met.select(F.explode(both).alias("p")).select("p.*"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("at").alias("t"), F.col("b").alias("partner"), F.col("bt").alias("u")), F.struct(F.col("b").alias("key"), F.col("bt").alias("t"), F.col("a").alias("partner"), F.col("at").alias("u"))))
    named = out.select(ways.alias("w")).select("w.*").join(numbered.select(F.col("g").alias("t"), F.col("task").alias("__own")), "t").join(numbered.select(F.col("g").alias("u"), F.col("task").alias("__other")), "u")
    return named.select(F.col("key").alias(key), "partner", F.col("__own").alias(task), F.col("__other").alias("partner_task"))
