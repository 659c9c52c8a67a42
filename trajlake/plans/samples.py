"""Samples, balanced batches and negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.keyed import draw, draw_sql
from trajlake.functions.vectors import matrix, rounded
from trajlake.operators import negatives, ranking, sampling
from trajlake.plans.registry import ORACLES, query
from trajlake.sources import episode_lengths, table

STEPS = WIDTH = 8


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 matrices of actions."""
    flat = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", matrix(flat, WIDTH).alias("actions"))


def _long(rows: DataFrame, column: str = "actions") -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("t", "row")).select("vec_id", F.col("t").cast("long").alias("t"), F.posexplode("row").alias("d", "x")).select("vec_id", "t", F.col("d").cast("long").alias("d"), "x")


_CELLS = "(select vec_id, label, p // 8 as t, p % 8 as d, x from (select vec_id, label, unnest(range(64)) as p, unnest(embedding)::double as x from embeddings))"


@query(f"""select user_id, event_type, rank from (select user_id, event_type, row_number() over (partition by event_type order by {draw_sql(7, "'clean'", "event_type", "user_id")}, user_id) as rank
from (select distinct user_id, event_type from events)) where rank <= 5""")
def sample_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    order = draw(7, "clean", F.col("event_type"), F.col("user_id"))
    return sampling.per_group(rows, "event_type", 5, order, F.col("user_id")).select("user_id", "event_type", "rank")


_NAME = "case when doc_id % 4 = 0 then 'x' || doc_id::varchar else doc_id::varchar end"


@query(f"""select source, name, rank from (select source, name, row_number() over (partition by source order by try_cast(name as bigint) is null, try_cast(name as bigint), name) as rank
from (select source, {_NAME} as name from documents)) where rank <= 10""")
def first_n_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each source in natural order (numbers before names)."""
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select("source", name.alias("name"))
    return sampling.per_group(rows, "source", 10, *sampling.natural(F.col("name"))).select("source", "name", "rank")


@query(f"""with rows as (select distinct user_id, event_type from events), g as (select event_type, row_number() over (order by event_type) - 1 as g, count(*) over () as groups from (select distinct event_type from rows)),
m as (select *, row_number() over (partition by event_type order by user_id) - 1 as k, count(*) over (partition by event_type) as size from rows),
c as (select event_id, event_type from events_ids join g on g.g = {draw_sql(7, "'group'", "event_id")} % groups)
select event_id, c.event_type as task, m.user_id from c join m on m.event_type = c.event_type and m.k = {draw_sql(7, "'row'", "event_id")} % m.size""".replace("events_ids", "(select distinct event_id from events)"))
def two_stage_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id", F.col("event_type").alias("task")).distinct()
    return sampling.two_stage(events.select("event_id").distinct(), "event_id", rows, "task", "user_id")


@query(f"""with p as (select vec_id, unnest(range(3)) as pass from embeddings),
r as (select pass, vec_id, row_number() over (order by pass * 4294967296 + {draw_sql(7, "'pass'", "pass", "vec_id")}, vec_id) - 1 as rn from p)
select pass, vec_id, rn, rn // 16 as batch_id from r""")
def coverage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.coverage(table(spark, sf_dir, "embeddings"), "vec_id", passes=3, half=16)


@query(f"""with pos as (select vec_id as key, 1 as label, row_number() over (order by {draw_sql(7, "'pass'", "0", "vec_id")}, vec_id) - 1 as rn from embeddings),
neg as (select event_id as key, 0 as label, row_number() over (order by event_id) - 1 as rn from events),
b as (select *, rn // 16 as batch_id from (select * from pos union all select * from neg)),
f as (select *, count(*) over (partition by batch_id) as n from b)
select batch_id, label, key, row_number() over (partition by batch_id order by {draw_sql(7, "'inside'", "label", "key")}, label, key) - 1 as place from f where n = 32""")
def balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of positives with as many negatives, half and half in each batch."""
    pos = sampling.coverage(table(spark, sf_dir, "embeddings"), "vec_id", passes=1, half=16).select(F.col("vec_id").alias("key"), "rn")
    neg = ranking.positions(table(spark, sf_dir, "events").select(F.col("event_id").alias("key")), F.col("key"))
    return sampling.balanced(pos, neg, half=16)


_ELIGIBLE = "(select user_id, n, row_number() over (order by user_id) - 1 as k, count(*) over () as total from (select user_id, count(*) as n from events group by 1) where n >= 64)"


@query(f"""with e as {_ELIGIBLE}, d as (select distinct event_id from events),
c as (select event_id, {draw_sql(7, "'source'", "event_id")} % total as k, {draw_sql(7, "'kind'", "event_id")} % (case when total > 1 then 5 else 4 end) as kind, total from d, (select distinct total from e)),
s as (select c.*, e.user_id, {draw_sql(7, "'window'", "event_id")} % (e.n // 16) as win, case when kind = 4 then (c.k + 1 + {draw_sql(7, "'partner'", "event_id")} % (c.total - 1)) % c.total end as pk from c join e on e.k = c.k)
select s.event_id, (['time_swap', 'joint_swap', 'flip_gripper', 'half_noise', 'swap_between_samples'])[kind + 1] as neg_type, s.user_id, win, p.user_id as partner from s left join e p on p.k = s.pk""")
def negative_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each draw a kind, a source with windows, a window, and for swaps a partner that is another source."""
    events = table(spark, sf_dir, "events")
    placed = ranking.positions(episode_lengths(events, 64), F.col("user_id"), name="k")
    total = placed.agg(F.count("*").alias("total"))  # one row
    key = F.col("event_id")
    kinds = F.when(F.col("total") > 1, 5).otherwise(4)
    drawn = events.select("event_id").distinct().crossJoin(F.broadcast(total)).where("total > 0").withColumns({"k": draw(7, "source", key) % F.col("total"), "kind": draw(7, "kind", key) % kinds})
    sourced = drawn.join(placed, "k").withColumn("win", draw(7, "window", key) % F.floor(F.col("n") / 16))
    partner = F.when(F.col("kind") == 4, sampling.other(F.col("k"), F.greatest(F.col("total"), F.lit(2)), 7, "partner", key))
    others = placed.select(F.col("k").alias("pk"), F.col("user_id").alias("partner"))
    names = F.array(*map(F.lit, negatives.KINDS))
    return sourced.withColumn("pk", partner).join(others, "pk", "left").select("event_id", F.get(names, F.col("kind").cast("int")).alias("neg_type"), "user_id", "win", "partner")


def _swap_sql(t: str, a: str, b: str) -> str:
    return f"(case when {t} = {a} then {b} when {t} = {b} then {a} else {t} end)"


def _drawn(purpose: str, *rest: str | int) -> str:
    return draw_sql(7, f"'{purpose}'", *rest)


_T1 = _swap_sql("t", f"{_drawn('time', 1, chr(39) + 'a' + chr(39), 'vec_id')} % 8", f"{_drawn('time', 1, chr(39) + 'b' + chr(39), 'vec_id')} % 8")
_T0 = _swap_sql("t1", f"{_drawn('time', 0, chr(39) + 'a' + chr(39), 'vec_id')} % 8", f"{_drawn('time', 0, chr(39) + 'b' + chr(39), 'vec_id')} % 8")


@query(f"""with moved as (select vec_id, t, d, {_T0} as src from (select vec_id, t, d, {_T1} as t1 from {_CELLS}))
select m.vec_id, m.t, m.d, c.x from moved m join {_CELLS} c on c.vec_id = m.vec_id and c.t = m.src and c.d = m.d""")
def neg_time_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that ends at t is found by undoing the exchanges, the last one first."""
    rows = _matrices(spark, sf_dir)
    return _long(rows.withColumn("actions", negatives.time_swap(F.col("actions"), STEPS, F.col("vec_id"))))


def _joint_sql() -> str:
    body = f"(select vec_id, t, d, d as d3 from {_CELLS})"
    for k in (2, 1, 0):
        a = f"({_drawn('from', k, 'vec_id')} % 7)"
        b = f"(({_drawn('from', k, 'vec_id')} % 7 + 1 + {_drawn('to', k, 'vec_id')} % 6) % 7)"
        dims = "([0, 1, 2, 3, 4, 5, 7])"
        swapped = _swap_sql(f"d{k + 1}", f"{dims}[{a} + 1]", f"{dims}[{b} + 1]")
        body = f"(select *, case when t = {_drawn('step', k, 'vec_id')} % 8 then {swapped} else d{k + 1} end as d{k} from {body})"
    return f"select s.vec_id, s.t, s.d, c.x from {body} s join {_CELLS} c on c.vec_id = s.vec_id and c.t = s.t and c.d = s.d0"


@query(_joint_sql())
def neg_joint_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matrices(spark, sf_dir)
    return _long(rows.withColumn("actions", negatives.joint_swap(F.col("actions"), STEPS, WIDTH, F.col("vec_id"))))


@query(f"select vec_id, t, d, case when d in (6, 13) then -x else x end as x from {_CELLS}")
def neg_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_matrices(spark, sf_dir).withColumn("actions", negatives.flip(F.col("actions"))))


_NOISE = f"sqrt(-2 * ln(({_drawn('u', 'vec_id', 't', 'd')} + 1) / 4294967297.0::double)) * cos(2 * 3.141592653589793 * (({_drawn('v', 'vec_id', 't', 'd')} + 1) / 4294967297.0::double))"


_NOISY = f"select vec_id, t, d, case when t >= 4 then x + 0.5 * ({_NOISE}) else x end as x from {_CELLS}"


@query(f"select vec_id, t, d, round(x, 6) as x from ({_NOISY})")
def neg_half_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(_matrices(spark, sf_dir).withColumn("actions", negatives.half_noise(F.col("actions"), STEPS, F.col("vec_id"))))
    return rows.withColumn("x", rounded(F.col("x")))


_PAIRS = f"(select (row_number() over (order by {_drawn('pair', 'vec_id')}, vec_id) - 1) // 2 as pair, vec_id from embeddings)"


@query(f"select a.vec_id, b.vec_id as partner from {_PAIRS} a join {_PAIRS} b on a.pair = b.pair and a.vec_id <> b.vec_id")
def neg_swap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.pairs(table(spark, sf_dir, "embeddings"), "vec_id")


def _matched(table_: str, key: str, task: str) -> str:
    """The matching by ranks; at each step what has two tasks is set aside."""
    return f"""with tasks as (select t, row_number() over (order by t nulls first) - 1 as g from (select distinct {task} as t from {table_})),
r as (select {key} as key, g as task from {table_} join tasks on t is not distinct from {task}),
o as (select *, row_number() over (order by {draw_sql(7, "'pair'", 'key')}, key) - 1 as rn, count(*) over () // 2 as half from r),
one as (select a.key as a, a.task as ta, b.key as b, b.task as tb from o a join o b on a.rn % 2 = 0 and b.rn = a.rn + 1 and b.rn < 2 * b.half),
pool as (select a as key, ta as task from one where ta = tb union all select b, tb from one where ta = tb),
q as (select *, row_number() over (order by task * 4294967296.0::double + {draw_sql(7, "'pool'", 'key')}, key) - 1 as rn, count(*) over () // 2 as half from pool),
two as (select a.key as a, a.task as ta, b.key as b, b.task as tb from q a join q b on a.rn < a.half and b.rn = a.rn + a.half),
x as (select *, row_number() over (order by {draw_sql(7, "'left'", 'a')}, a) as rn from two where ta = tb),
done as (select *, coalesce(ta <> (select max(ta) from x) and tb <> (select max(ta) from x), false) as able from (select * from one where ta <> tb union all select * from two where ta <> tb)),
y as (select *, row_number() over (order by {draw_sql(7, "'giver'", 'a')}, a) as rn from done where able),
pairs as (select x.a, x.ta, y.a as b, y.ta as tb from x join y using (rn) union all select x.b, x.tb, y.b, y.tb from x join y using (rn)
  union all select a, ta, b, tb from x anti join y using (rn) union all select a, ta, b, tb from y anti join x using (rn) union all select a, ta, b, tb from done where not able),
ways as (select a as key, ta as task, b as partner, tb as other from pairs union all select b, tb, a, ta from pairs)
select key as {key}, partner, k.t as {task}, l.t as partner_task from ways join tasks k on k.g = ways.task join tasks l on l.g = ways.other"""


@query(_matched("embeddings", "vec_id", "label"))
def neg_swap_prefer_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of other tasks, for all that can have one."""
    return negatives.pairs_across(table(spark, sf_dir, "embeddings"), "vec_id", "label")


@query(_matched("(select doc_id, case when lang <> 'en' then lang when doc_id % 5 = 0 then null else 'main' end as task from documents)", "doc_id", "task"))
def neg_swap_large_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one task may have most rows: its surplus is paired within."""
    task = F.when(F.col("lang") != "en", F.col("lang")).when(F.col("doc_id") % 5 != 0, "main")
    return negatives.pairs_across(table(spark, sf_dir, "documents").select("doc_id", task.alias("task")), "doc_id", "task")


def _fanout_sql() -> str:
    """Each corruption by its own SQL, summed with a weight for each place, and the swaps."""
    placed = "sum(x * (t * 8 + d + 1))"
    own = f"(select vec_id, label, {placed} as tokens from {_CELLS} group by 1, 2)"
    parts = [f"select vec_id, '{kind}' as neg_type, null::bigint as partner, {placed} as actions from ({sql}) group by vec_id" for kind, sql in zip(negatives.KINDS, (*(ORACLES[n] for n in ("neg_time_swap", "neg_joint_swap", "neg_flip")), _NOISY))]
    parts.append(f"select p.vec_id, 'swap_between_samples', p.partner, {placed} from ({ORACLES['neg_swap_pairs']}) p join {_CELLS} c on c.vec_id = p.partner group by p.vec_id, p.partner")
    return f"select n.vec_id, n.neg_type, 0 as label, o.label as task, n.partner, q.label as partner_task, round(n.actions, 3) as actions, round(o.tokens, 3) as tokens from ({' union all '.join(parts)}) n join {own} o on o.vec_id = n.vec_id left join embeddings q on q.vec_id = n.partner"


@query(_fanout_sql())
def neg_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corruptions of each sample and, where it has a partner, one row with the partner's actions and its own tokens: 4 n + 2 (n / 2)
    rows with what they came from.  Matrices are given as sums weighted by place."""
    placed = lambda m: rounded(F.aggregate(F.transform(F.flatten(m), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)
    rows = negatives.fan_out(_matrices(spark, sf_dir), "vec_id", "label", "actions", STEPS, WIDTH)
    return rows.select("vec_id", "neg_type", "label", "task", "partner", "partner_task", placed("actions").alias("actions"), placed("tokens").alias("tokens"))


@query(f"""with b as (select vec_id, t // 2 as block, t % 2 as r, d, x from {_CELLS})
select a.vec_id, a.block as token_now, least(a.block + 1, 3) as token_next, a.r, a.d, a.x, n.x as next_x from b a join b n on n.vec_id = a.vec_id and n.block = least(a.block + 1, 3) and n.r = a.r and n.d = a.d""")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of two rows, and the values of the block after it; the last stands for itself."""
    blocks = _matrices(spark, sf_dir).select("vec_id", "actions", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("token_now")).withColumn("token_next", F.least(F.col("token_now") + 1, F.lit(3).cast("long")))
    cells = [F.flatten(F.slice("actions", (2 * F.col(k) + 1).cast("int"), F.lit(2))) for k in ("token_now", "token_next")]
    rows = blocks.select("vec_id", "token_now", "token_next", F.posexplode(F.arrays_zip(cells[0].alias("x"), cells[1].alias("next_x"))).alias("p", "z"))
    return rows.select("vec_id", "token_now", "token_next", F.floor(F.col("p") / WIDTH).alias("r"), (F.col("p") % WIDTH).cast("long").alias("d"), "z.x", "z.next_x")


@query("""select vec_id, count(*) as n, count(*) filter (where x > 0) as valid, round(coalesce(sum(x) filter (where x > 0), 0), 6) as total
from (select vec_id, unnest(embedding)::double as x from embeddings) group by vec_id""")
def mask_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.functions.vectors import valid_only

    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).withColumn("kept", valid_only(F.col("x"), F.transform("x", lambda v: v > 0)))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.size("kept").cast("long").alias("valid"), rounded(F.aggregate("kept", F.lit(0.0), lambda a, v: a + v)).alias("total"))
