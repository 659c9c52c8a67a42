"""Geometry, masks, schedules and flow arithmetic over sizes and values of the tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.functions import schedules as sch
from trajlake.functions.vectors import rounded
from trajlake.plans.registry import query
from trajlake.sources import episode_lengths, table
from trajlake.plans.trajectories import LENGTHS

_SIZES = "(select p_partkey, (p_size * 37 + 60)::bigint as h, (p_partkey % 50 * 29 + 70)::bigint as w from part)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights and widths made of the parts' sizes and keys."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 60).cast("long").alias("h"), (F.col("p_partkey") % 50 * 29 + 70).cast("long").alias("w"))


_LEAST, _MOST = 56 * 56, 200_000


@query(f"""with r as (select *, greatest(28, round_even(h / 28, 0) * 28) as rh, greatest(28, round_even(w / 28, 0) * 28) as rw, sqrt(h * w / {_MOST}.0::double) as shrink, sqrt({_LEAST}.0::double / (h * w)) as grow from {_SIZES})
select p_partkey, h, w, (case when rh * rw > {_MOST} then floor(h / shrink / 28) * 28 when rh * rw < {_LEAST} then ceil(h * grow / 28) * 28 else rh end)::bigint as new_h,
(case when rh * rw > {_MOST} then floor(w / shrink / 28) * 28 when rh * rw < {_LEAST} then ceil(w * grow / 28) * 28 else rw end)::bigint as new_w from r""")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = geo.budget_size(F.col("h"), F.col("w"), least=_LEAST, most=_MOST)
    return _sizes(spark, sf_dir).select("p_partkey", "h", "w", h.alias("new_h"), w.alias("new_w"))


@query(f"""with s as (select *, least(384.0::double / h, 320.0::double / w) as scale from {_SIZES}), d as (select *, floor(h * scale)::bigint as new_h, floor(w * scale)::bigint as new_w from s)
select p_partkey, new_h, new_w, (384 - new_h) // 2 as top, (320 - new_w) // 2 as "left" from d""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = geo.letterbox(F.col("h"), F.col("w"), 384, 320)
    return _sizes(spark, sf_dir).select("p_partkey", *(c.alias(n) for n, c in fitted.items()))


_AREA = 500_000


@query(f"""with a as (select *, w / h as ratio from {_SIZES}), b as (select *, sqrt({_AREA} * ratio) as ow, {_AREA}.0::double / sqrt({_AREA} * ratio) as oh from a),
c as (select *, floor(ow / 32) * 32 as w1, floor(oh / 32) * 32 as h2 from b), d as (select *, floor({_AREA} / w1 / 32) * 32 as h1, floor({_AREA} / h2 / 32) * 32 as w2 from c),
e as (select *, greatest(ratio / (w1 / h1), (w1 / h1) / ratio) as o1, greatest(ratio / (w2 / h2), (w2 / h2) / ratio) as o2 from d)
select p_partkey, (case when o1 < o2 then h1 else h2 end)::bigint as out_h, (case when o1 < o2 then w1 else w2 end)::bigint as out_w from e""")
def best_output_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = geo.best_size(F.col("h"), F.col("w"), 32, 32, _AREA)
    return _sizes(spark, sf_dir).select("p_partkey", h.alias("out_h"), w.alias("out_w"))


@query(f"""with g as (select p_partkey, h // 112 as gh, w // 112 as gw from {_SIZES}), c as (select *, unnest(range(gh * gw)) as cell from g),
x as (select *, cell // gw as r, cell % gw as q from c), n as (select *, (r // 4) * ((gw + 3) // 4) + q // 4 as win from x),
k as (select p_partkey, win, count(*) as cells from n group by 1, 2)
select p_partkey, win, cells, sum(cells) over (partition by p_partkey order by win rows unbounded preceding)::bigint as upto from k""")
def window_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid cut into windows of 4 x 4 cells, and the running number of cells."""
    from pyspark.sql import Window

    grid = _sizes(spark, sf_dir).select("p_partkey", F.floor(F.col("h") / 112).alias("gh"), F.floor(F.col("w") / 112).alias("gw")).where("gh * gw > 0")
    cells = grid.select("p_partkey", "gw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gh") * F.col("gw") - 1)).alias("cell"))
    win = F.floor(F.floor(F.col("cell") / F.col("gw")) / 4) * F.floor((F.col("gw") + 3) / 4) + F.floor(F.col("cell") % F.col("gw") / 4)
    counted = cells.select("p_partkey", win.alias("win")).groupBy("p_partkey", "win").agg(F.count("*").alias("cells"))
    return counted.withColumn("upto", F.sum("cells").over(Window.partitionBy("p_partkey").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""with g as (select p_partkey, p_partkey % 3 + 1 as steps, h // 112 as gh, w // 112 as gw from {_SIZES}), c as (select *, unnest(range(steps * gh * gw)) as cell from g),
x as (select *, cell // (gh * gw) as t, cell % (gh * gw) // gw as r, cell % gw as q from c), n as (select *, (t * ((gh + 3) // 4) + r // 4) * ((gw + 3) // 4) + q // 4 as win from x)
select p_partkey, cell, win, row_number() over (partition by p_partkey order by win, r, q) - 1 as place, (count(*) over (partition by p_partkey order by win)) * 4 as upto from n""")
def window_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid over time in the order of windows of 4 x 4; windows at the edges hold fewer cells, and none reaches over two steps.
    upto: the tokens, four a cell, up to the end of the cell's window."""
    from pyspark.sql import Window

    grid = _sizes(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 3 + 1).alias("steps"), F.floor(F.col("h") / 112).alias("gh"), F.floor(F.col("w") / 112).alias("gw")).where("gh * gw > 0")
    cells = grid.select("p_partkey", "gh", "gw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") * F.col("gh") * F.col("gw") - 1)).alias("cell"))
    frame = F.col("gh") * F.col("gw")
    placed = cells.withColumns({"t": F.floor(F.col("cell") / frame), "r": F.floor(F.col("cell") % frame / F.col("gw")), "q": F.col("cell") % F.col("gw")})
    win = (F.col("t") * F.floor((F.col("gh") + 3) / 4) + F.floor(F.col("r") / 4)) * F.floor((F.col("gw") + 3) / 4) + F.floor(F.col("q") / 4)
    part = Window.partitionBy("p_partkey")
    return placed.withColumn("win", win).select("p_partkey", "cell", "win", (F.row_number().over(part.orderBy("win", "r", "q")) - 1).cast("long").alias("place"), (F.count("*").over(part.orderBy("win")) * 4).alias("upto"))


@query(f"""with g as (select p_partkey, h // 224 * 2 as gh, w // 224 * 2 as gw from {_SIZES}), c as (select *, unnest(range(gh * gw)) as i from g)
select p_partkey, i, ((i // gw) // 2) * (gw // 2) + (i % gw) // 2 as patch, ((i // gw) % 2) * 2 + (i % gw) % 2 as inside from c""")
def patch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cell of a grid, its patch of 2 x 2 and its place in there."""
    grid = _sizes(spark, sf_dir).select("p_partkey", (F.floor(F.col("h") / 224) * 2).alias("gh"), (F.floor(F.col("w") / 224) * 2).alias("gw")).where("gh * gw > 0")
    cells = grid.select("p_partkey", "gw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gh") * F.col("gw") - 1)).alias("i"))
    r, q = F.floor(F.col("i") / F.col("gw")), F.col("i") % F.col("gw")
    return cells.select("p_partkey", "i", (F.floor(r / 2) * F.floor(F.col("gw") / 2) + F.floor(q / 2)).alias("patch"), (r % 2 * 2 + q % 2).alias("inside"))


#: What a query token may see, for group numbers 0 (context), 1 (actions), 2 (future), 3 (summary).
_GROUP = "case when i < turns then 0 when i < turns + 4 then 1 when i < turns + 6 then 2 else 3 end"


@query(f"""with c as (select conv_id, count(*) as turns from conversations group by 1), t as (select conv_id, turns, i, {_GROUP} as g from (select *, unnest(range(turns + 7)) as i from c))
select q.conv_id, q.i as q, k.i as k, not (q.g = 3 or q.g = 0 and k.g = 0 or q.g = 1 and (k.g = 0 or k.g = 1 and k.i <= q.i) or q.g = 2 and k.g <> 3) as blocked from t q join t k on k.conv_id = q.conv_id""")
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which token pairs are blocked: context sees context, actions see context and earlier actions, the future sees all but the
    summary, the summary sees all."""
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))

    def group(i: str) -> Column:
        return F.when(F.col(i) < F.col("turns"), 0).when(F.col(i) < F.col("turns") + 4, 1).when(F.col(i) < F.col("turns") + 6, 2).otherwise(3)

    every = F.sequence(F.lit(0).cast("long"), F.col("turns") + 6)
    pairs = sizes.withColumn("q", F.explode(every)).withColumn("k", F.explode(every)).withColumns({"qg": group("q"), "kg": group("k")})
    seen = F.expr("qg = 3 or (qg = 0 and kg = 0) or (qg = 1 and (kg = 0 or (kg = 1 and k <= q))) or (qg = 2 and kg <> 3)")
    return pairs.select("conv_id", "q", "k", (~seen).alias("blocked"))


_FAR = f"least(15, 8 + floor(round(ln(abs(dist) / 8) / {math.log(128 / 8)!r}::double * 8, 9)))"


@query(f"""with d as (select l_orderkey, l_linenumber, l_suppkey - l_partkey as dist from lineitem)
select l_orderkey, l_linenumber, dist, ((case when dist > 0 then 16 else 0 end) + case when abs(dist) < 8 then abs(dist) else {_FAR} end)::bigint as bucket from d""")
def rel_pos_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.col("l_suppkey") - F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", distance.alias("dist"), sch.relative_bucket(distance).alias("bucket"))


#: Steps of a schedule: as many as an episode has frames.
_STEPS = f"(select user_id, n, unnest(range(n)) as i from {LENGTHS})"
_LOW = f"{sch.LOW_SIGMA!r}::double"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_lengths(table(spark, sf_dir, "events")).select("user_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))


@query(f"""with s as (select user_id, n, i, 1.0::double - i * ((1.0::double - {_LOW}) / greatest(n - 1, 1)) as even from {_STEPS}),
g as (select *, 5.0::double * even / (1 + 4.0::double * even) as sigma from s), b as (select *, exp(-2 * power((sigma * 1000 - n / 2.0::double) / n, 2)) as bell from g),
w as (select *, min(bell) over (partition by user_id) as least, sum(bell) over (partition by user_id) as whole from b)
select user_id, i, round(sigma, 6) as sigma, round(sigma * 1000, 6) as timestep, round((bell - least) * n / nullif(whole - n * least, 0), 6) as weight from w""")
def sigma_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted sigmas, their timesteps, and the timesteps' training weights."""
    from pyspark.sql import Window

    sigma = sch.shifted(sch.even_sigma(F.col("i"), F.col("n")), 5.0)
    timed = _steps(spark, sf_dir).withColumn("sigma", sigma).withColumn("timestep", F.col("sigma") * sch.TIMESTEPS)
    weight = sch.bell_weights(sch.bell(F.col("timestep"), F.col("n")), F.col("n"), Window.partitionBy("user_id"))
    return timed.select("user_id", "i", rounded(F.col("sigma")).alias("sigma"), rounded(F.col("timestep")).alias("timestep"), rounded(weight).alias("weight"))


@query(f"""with s as (select user_id, n, i, 1.0::double - i * (1.0::double / n) as open_end, 1.0::double - (n - 1 - i) * ((1.0::double - {_LOW}) / greatest(n - 1, 1)) as rising,
1.0::double - i * ((1.0::double - {_LOW}) / greatest(n - 1, 1)) as even, 1.0::double - (n - 1) * ((1.0::double - {_LOW}) / greatest(n - 1, 1)) as last, n * ((0.9::double - 0.5) / (8192 - 256)) + (0.5 - (0.9::double - 0.5) / (8192 - 256) * 256) as mu from {_STEPS}),
g as (select *, exp(mu) / (exp(mu) + (1 / even - 1)) as bent, exp(mu) / (exp(mu) + (1 / last - 1)) as bent_last from s)
select user_id, i, round(3.0::double * open_end / (1 + 2.0::double * open_end), 6) as open_end, round(3.0::double * rising / (1 + 2.0::double * rising), 6) as rising, round(bent, 6) as exponential,
round(1 - (1 - bent) / ((1 - bent_last) / (1 - 0.02::double)), 6) as terminal, round(1 - bent, 6) as reversed from g where n > 1""")
def sigma_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule without its last step, from low to high, with an exponential shift by length, stretched to a given end, and reversed."""
    i, n = F.col("i"), F.col("n")
    mu = sch.interpolated_shift(n)
    bent, last = sch.exponentially_shifted(sch.even_sigma(i, n), mu), sch.exponentially_shifted(sch.even_sigma(n - 1, n), mu)
    kinds = {"open_end": sch.shifted(sch.even_sigma(i, n, low=0.0, open_end=True), 3.0), "rising": sch.shifted(sch.even_sigma(i, n, rising=True), 3.0), "exponential": bent, "terminal": sch.ending_at(bent, last, 0.02), "reversed": 1 - bent}
    return _steps(spark, sf_dir).where("n > 1").select("user_id", "i", *(rounded(c).alias(k) for k, c in kinds.items()))


@query(f"""select p_partkey, h + h // 2 as half_h, h + greatest(h // 3, w // 2) as wrist_h, w as out_w, w // 2 as split, w - w // 2 as right_w, floor(w * 1.5)::bigint as announced_w from {_SIZES}""")
def stitched_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to say how large a stitched frame is: by halves, by the higher of two lower views, and as announced."""
    h, w = F.col("h"), F.col("w")
    half, wrist = geo.stitched_size(h, w), geo.stitched_size(h, w, (F.floor(h / 3), F.floor(w / 2)))
    parts = geo.stitched_parts(h, w)
    return _sizes(spark, sf_dir).select("p_partkey", half[0].alias("half_h"), wrist[0].alias("wrist_h"), wrist[1].alias("out_w"), parts["split"].alias("split"), parts["right_w"].alias("right_w"), geo.announced_size(h, w)[1].alias("announced_w"))


@query(f"""with g as (select p_partkey, h // 224 * 2 as gh, w // 224 * 2 as gw from {_SIZES}), c as (select *, unnest(range(gh * gw)) as k from g), p as (select *, k // 4 as patch, k % 4 as inside from c)
select p_partkey, k, (patch // (gw // 2) * 2 + inside // 2) * gw + patch % (gw // 2) * 2 + inside % 2 as i from p""")
def unpatchify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse of patch_index: of each place in the order of patches of 2 x 2, the cell of the grid."""
    grid = _sizes(spark, sf_dir).select("p_partkey", (F.floor(F.col("h") / 224) * 2).alias("gh"), (F.floor(F.col("w") / 224) * 2).alias("gw")).where("gh * gw > 0")
    places = grid.select("p_partkey", "gw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gh") * F.col("gw") - 1)).alias("k"))
    patch, inside, across = F.floor(F.col("k") / 4), F.col("k") % 4, F.floor(F.col("gw") / 2)
    return places.select("p_partkey", "k", ((F.floor(patch / across) * 2 + F.floor(inside / 2)) * F.col("gw") + patch % across * 2 + inside % 2).alias("i"))


@query("""with x as (select vec_id, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings), m as (select *, max(x) over (partition by vec_id) as top from x)
select vec_id, dim, floor(least(greatest(x, 0), 1) * 255)::bigint as cut_off, floor(least(greatest(case when top <= 1 then x * 255 else x end, 0), 255))::bigint as by_range, floor(least(greatest(case when top * 300 <= 1 then x * 76500 else x * 300 end, 0), 255))::bigint as large from m""")
def byte_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by cutting off, and by the range of each image: scaled only where nothing is above 1."""
    x, top = F.col("x").cast("double"), F.col("top").cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array_max("embedding").alias("top"), F.posexplode("embedding").alias("dim", "x"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), sch.to_byte(x, truncate=True).alias("cut_off"), sch.to_byte_by_range(x, top).alias("by_range"), sch.to_byte_by_range(x * 300, top * 300).alias("large"))


@query("""with x as (select vec_id, unnest(range(64)) as dim, unnest(embedding)::double as x, unnest(list_reverse(embedding))::double as y from embeddings),
s as (select *, vec_id % 10 / 10.0::double as sigma from x)
select vec_id, dim, round((1 - sigma) * x + sigma * y, 6) as noised, round(x + (y - x) * (sigma - 1), 6) as stepped, round(x + 3 * (y - x), 6) as guided, round_even(least(greatest(x, 0), 1) * 255, 0)::bigint as byte from s""")
def flow_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector and its reverse as data and noise: interpolation, one step, guidance, and bytes."""
    zipped = F.arrays_zip(F.col("embedding").alias("x"), F.reverse("embedding").alias("y"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(zipped).alias("dim", "z"), (F.col("vec_id") % 10 / 10.0).alias("sigma"))
    x, y, sigma = F.col("z.x").cast("double"), F.col("z.y").cast("double"), F.col("sigma")
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), rounded(sch.add_noise(x, y, sigma)).alias("noised"), rounded(sch.euler_step(x, y - x, F.lit(1.0), sigma)).alias("stepped"), rounded(sch.guided(x, y, 3.0)).alias("guided"), sch.to_byte(x).alias("byte"))


@query("""with r as (select vec_id, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings),
a as (select *, x + (x * 0.5::double - 1.0::double) * (0.6::double - 1.0::double) as x1 from r), b as (select *, greatest(x1, -1) + (x1 * 0.5::double - 0.6::double) * (0.3::double - 0.6::double) as x2 from a),
c as (select *, greatest(x2, -1) + (x2 * 0.5::double - 0.3::double) * (0.0::double - 0.3::double) as x3 from b)
select vec_id, dim, round(x3, 6) as x from c""")
def hooked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of a schedule with a velocity and a clipping step of one's own."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    clipped = lambda x, v, now, then: F.greatest(x, F.lit(-1.0)) + v * (then - now)
    x = sch.stepped_by(F.col("x").cast("double"), [1.0, 0.6, 0.3, 0.0], lambda x, now: x * 0.5 - now, clipped)
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), rounded(x).alias("x"))
