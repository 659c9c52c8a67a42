"""Draws by weight, by split, over windows; modes of sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake import datasets
from trajlake.functions.keyed import draw, draw_sql
from trajlake.operators import sampling, windows
from trajlake.plans.registry import ORACLES, query
from trajlake.plans.statistics import RANGES, VALUES
from trajlake.plans.trajectories import FRAMES, LENGTHS, LONG, WIDE
from trajlake.sources import episode_lengths, table
from trajlake.streaming import coverage

_TASKS = "(select event_type as task, count(*)::double as weight from events where event_type <> 'error' group by 1 union all select 'nothing', 500.0)"


@query(f"""with w as (select task, weight, row_number() over (order by task) - 1 as g, sum(weight) over (order by task rows unbounded preceding) as upto, sum(weight) over () as whole from {_TASKS}),
m as (select event_type as task, user_id, row_number() over (partition by event_type order by user_id) - 1 as k, count(*) over (partition by event_type) as size from (select distinct event_type, user_id from events)),
a as (select event_id, {draw_sql(7, "'task'", "event_id")} / 4294967296.0::double * (select any_value(whole) from w) as place from (select distinct event_id from events)),
c as (select event_id, (select count(*) from w where upto <= place) as g from a)
select c.event_id, w.task, m.user_id from c join w on w.g = c.g left join m on m.task = w.task and m.k = {draw_sql(7, "'row'", "event_id")} % m.size""")
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each draw a task by weight, then an episode of it; a task without episodes keeps its weight and its draws come to nothing."""
    events = table(spark, sf_dir, "events")
    own = events.where("event_type <> 'error'").groupBy(F.col("event_type").alias("task")).agg(F.count("*").cast("double").alias("weight"))
    weights = own.unionByName(spark.range(1).select(F.lit("nothing").alias("task"), F.lit(500.0).alias("weight")))
    rows = events.select(F.col("event_type").alias("task"), "user_id").distinct()
    return sampling.weighted_two_stage(events.select("event_id").distinct(), "event_id", weights, rows, "task", "user_id")


@query(f"""with e as (select user_id, greatest(n - 40, 0) // 4 as windows from {LENGTHS}), p as (select user_id, windows, row_number() over (order by {draw_sql(7, "'coverage'", "user_id")}, user_id) - 1 as place from e where windows > 0)
select place, user_id, {draw_sql(7, "'window'", "place", "user_id")} % windows as "window" from p""")
def positive_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in an order that covers all before one comes again, each with one of its windows; those without a window are skipped."""
    sources = episode_lengths(table(spark, sf_dir, "events")).select("user_id", F.floor(F.greatest(F.col("n") - 40, F.lit(0)) / 4).alias("windows"))
    return sampling.positives(sources, "user_id", "windows")


_SHARDS, _PER_REQUEST = 8, 16


@query(f"""with e as (select user_id, greatest(n - 40, 0) // 4 as windows, {draw_sql(7, "'shard'", "user_id")} % {_SHARDS} as shard from {LENGTHS}),
p as (select *, {draw_sql(7, "'pass'", "pass", "user_id")} as spot from (select *, unnest(range(3)) as pass from e) where pass = 0 or windows > 0),
o as (select *, row_number() over (partition by shard, pass order by spot, user_id) - 1 as place from p),
d as (select *, row_number() over (partition by shard order by pass, spot, user_id) - 1 as draw from o where windows > 0)
select shard, draw // {_PER_REQUEST} as request, draw, pass, place, user_id as source, {draw_sql(7, "'window'", "pass", "user_id")} % windows as "window" from d""")
def stateful_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over all sources, drawn sixteen at a time: each request goes on where the one before it ended."""
    sources = episode_lengths(table(spark, sf_dir, "events")).select(coverage.shard_of(F.col("user_id"), _SHARDS, 7).alias("shard"), F.col("user_id").alias("source"), F.floor(F.greatest(F.col("n") - 40, F.lit(0)) / 4).alias("windows"))
    wanted = sources.where("windows > 0").groupBy("shard").agg((3 * F.count("*")).alias("draws"))
    last = F.ceil(F.col("draws") / _PER_REQUEST) - 1
    requests = wanted.select("shard", "draws", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("request"))
    return coverage.draws(sources, requests.select("shard", "request", F.least(F.lit(_PER_REQUEST), F.col("draws") - _PER_REQUEST * F.col("request")).cast("long").alias("draws")))


_SEED = "case when split = 'clean' then 7 else 1000010 end"


@query(f"""with r as (select distinct case when user_id % 3 = 0 then 'randomized' else 'clean' end as split, event_type, user_id from events)
select split, event_type, user_id, rank from (select *, row_number() over (partition by split, event_type order by {draw_sql(_SEED, "event_type", "user_id")}, user_id) as rank from r) where rank <= 4""")
def sample_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of each task and split; splits other than clean draw from a seed of their own."""
    split = F.when(F.col("user_id") % 3 == 0, "randomized").otherwise("clean")
    rows = table(spark, sf_dir, "events").select(split.alias("split"), "event_type", "user_id").distinct()
    return sampling.per_split(rows, "split", "event_type", "user_id", 4).select("split", "event_type", "user_id", "rank")


@query(" union all ".join(f"select '{mode}' as mode, user_id, count(*) as n_rows, sum(action_idx * (pos + 1))::bigint as placed from ({ORACLES[name]}) group by user_id" for mode, name in (("Strict", "window_strict"), (" tail-padding", "window_tail_padding"), ("RANDOM_STRICT-FILL", "window_random_strict_fill"))))
def window_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by the name of their mode, however it is written."""
    lengths = episode_lengths(table(spark, sf_dir, "events"), 2)
    out = None
    for mode, spec in (("Strict", LONG), (" tail-padding", WIDE), ("RANDOM_STRICT-FILL", WIDE)):
        found = windows.sample(lengths, spec, mode).groupBy("user_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("action_idx") * (F.col("pos") + 1)).alias("placed"))
        found = found.select(F.lit(mode).alias("mode"), "user_id", "n_rows", "placed")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""select user_id, n, k, i as pos, round_even(i * (n - 1) / greatest(k - 1, 1), 0)::bigint as idx
from (select *, (round_even(least(greatest(n / 10.0::double * 2, 4), floor(least(24, n) / 2) * 2) / 2, 0) * 2)::bigint as k from {LENGTHS} where n >= 4), (select unnest(range(24)) as i) where i < k""")
def even_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an episode at a fifth of its rate, an even number of at most 24."""
    sized = episode_lengths(table(spark, sf_dir, "events"), 4).withColumn("k", windows.even_count(F.col("n"), F.lit(10.0), 2.0, 4, 24))
    return sized.select("user_id", "n", "k", F.posexplode(windows.resampled(F.col("n"), F.col("k"))).alias("pos", "idx")).withColumn("pos", F.col("pos").cast("long"))


_VARIANT = draw_sql(5, "'variant'", "vec_id")


@query(f"select vec_id, case when vec_id % 4 = 0 then 0 else {_VARIANT} % 4 end as variant, round(list_sum(list_transform(embedding[(case when vec_id % 4 = 0 then 0 else {_VARIANT} % 4 end) * 16 + 1:(case when vec_id % 4 = 0 then 0 else {_VARIANT} % 4 end) * 16 + 16], lambda x: x::double)), 6) as total from embeddings")
def embedding_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the embeddings a sample has, drawn; a sample with a single one takes that."""
    from trajlake.functions.vectors import matrix, rounded, squeeze

    variant = F.when(F.col("vec_id") % 4 == 0, 0).otherwise(draw(5, "variant", F.col("vec_id")) % 4)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", variant.alias("variant"), matrix(F.transform("embedding", lambda x: x.cast("double")), 16).alias("variants"))
    own = squeeze(F.array(F.get("variants", F.col("variant").cast("int"))))
    return rows.select("vec_id", "variant", rounded(F.aggregate(own, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""select 'episodes' as kind, user_id::varchar as name, n, round(total, 6) as total from (select w.user_id, count(*) as n, sum(f.value) as total from ({ORACLES["window_strict"]}) w left join {FRAMES} f on f.user_id = w.user_id and f.frame_idx = w.action_idx group by 1)
union all select 'vectors', label::varchar, count(*), round(sum((x - low) / case when high = low then 1 else high - low end), 6) from {VALUES} join {RANGES} using (dim) group by label""")
def datasets_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets from their configurations: windows of episodes with their values, and normalised vectors, summed up."""
    common = {"global_downsample_rate": LONG.stride, "video_action_freq_ratio": LONG.ratio, "num_video_frames": LONG.frames, "video_height": 384}
    found = datasets.create(spark, {"common": common, "dataset": {"dataset_dir": sf_dir, "params": {"sampling_mode": "strict"}}})
    own = datasets.create(spark, {"common": common, "dataset": {"type": "vectors", "dataset_dir": sf_dir}})
    parts = [(found, "episodes", F.col("user_id").cast("string"), "value"), (own, "vectors", F.col("task"), "x")]
    sums = [rows.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("n"), F.round(F.sum(x), 6).alias("total")) for rows, kind, name, x in parts]
    return sums[0].unionByName(sums[1])
