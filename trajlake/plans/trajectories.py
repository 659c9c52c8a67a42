"""Episodes, index windows, gathers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.keyed import draw, draw_sql
from trajlake.functions.vectors import normalise, rounded
from trajlake.operators import asof, lookups, windows
from trajlake.operators.windows import Spec
from trajlake.plans.registry import query
from trajlake.sources import episode_frames, episode_lengths, table

FRAMES = "(select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, ts, event_id, event_type, value from events)"
LENGTHS = "(select user_id, count(*) as n from events group by user_id)"
LONG, WIDE = Spec(frames=8, ratio=2, stride=4), Spec(frames=8, ratio=4, stride=8)
SHORT = Spec(frames=6, ratio=2, stride=1)


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_lengths(table(spark, sf_dir, "events"), least=2)


@query(f"select user_id, frame_idx, event_id, value, frame_idx + 1 as frames_so_far from {FRAMES}", name="episode_frames")
def frames_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = episode_frames(table(spark, sf_dir, "events"))
    return frames.select("user_id", "frame_idx", "event_id", "value", (F.col("frame_idx") + 1).alias("frames_so_far"))


@query(f"select user_id, n from {LENGTHS} where n >= 2", name="episode_lengths")
def lengths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir)


def _feasible(s: Spec) -> str:
    return f"(case when {s.actions} >= {2 * s.ratio} and n - 1 - {max(min(2, s.frames), 2) * s.ratio * s.stride} >= 0 then n - 1 - {max(min(2, s.frames), 2) * s.ratio * s.stride} end)"


@query(f"select user_id, n, {_feasible(WIDE)} as max_c from {LENGTHS}")
def feasible_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).withColumn("max_c", windows.greatest_start(F.col("n"), WIDE))


def _strict(s: Spec) -> str:
    return f"(case when n - {s.span} <= 0 then 0 else {draw_sql(7, "'strict'", 'user_id')} % (n - {s.span}) end)"


def _video(s: Spec) -> str:
    return f"case when (i + 1) % {s.ratio} = 0 then i // {s.ratio} end as video_pos"


def _clamped(s: Spec) -> str:
    return f"least(c + (i + 1) * {s.stride}, n - 1) as action_idx"


def _steps(s: Spec) -> str:
    return f"(select unnest(range({s.actions})) as i)"


_STRICT = f"select user_id, n, c, i as pos, {_clamped(LONG)}, {_video(LONG)} from (select *, {_strict(LONG)} as c from {LENGTHS}), {_steps(LONG)}"


@query(_STRICT)
def window_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.strict(_lengths(spark, sf_dir), LONG)


_TAIL = f"""select user_id, n, c, i as pos, c + (i + 1) * {WIDE.stride} as action_idx, {_video(WIDE)}, c + (i + 1) * {WIDE.stride} < n as valid
from (select user_id, n, {draw_sql(7, "'tail'", "user_id")} % (m + 1) as c from (select *, {_feasible(WIDE)} as m from {LENGTHS}) where m is not null), {_steps(WIDE)}"""


@query(_TAIL)
def window_tail_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tail_padding(_lengths(spark, sf_dir), WIDE)


@query(f"""select user_id, n, m is null as fallback, c, i as pos, {_clamped(WIDE)}, {_video(WIDE)}
from (select *, coalesce({draw_sql(7, "'fill'", "user_id")} % (m + 1), {_strict(WIDE)}) as c from (select *, {_feasible(WIDE)} as m from {LENGTHS})), {_steps(WIDE)}""")
def window_random_strict_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.random_strict_fill(_lengths(spark, sf_dir), WIDE)


_TILED = f"select user_id, n, c, i as pos, {_clamped(SHORT)}, {_video(SHORT)} from (select *, unnest(range(0, n, {SHORT.span})) as c from {LENGTHS}), {_steps(SHORT)}"


@query(_TILED)
def window_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tiled(_lengths(spark, sf_dir), SHORT)


@query(f"""with w as (select user_id, n, unnest(range(0, n - 1 - 28 + 1, 8)) as c from (select * from {LENGTHS} where n - 1 - 28 >= 0))
select user_id, n, c, 'video' as kind, k - 1 as pos, c + k * 4 as idx from w, (select unnest(range(1, 4)) as k)
union all select user_id, n, c, 'action', k, c + (6 + k) * 2 from w, (select unnest(range(9)) as k)""")
def window_binary_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.overlapping(_lengths(spark, sf_dir), ratio=2, stride=2)


@query(f"""select user_id, n, c, i as pos, least(c + (i + 1) * 5, n - 1) as video_idx, least(c + i * 5, n - 2) as action_idx
from (select *, case when n - 60 <= 0 then 0 else {draw_sql(7, "'latent'", "user_id")} % (n - 60) end as c from {LENGTHS} where n >= 3), (select unnest(range(12)) as i)""")
def window_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latent(_lengths(spark, sf_dir), frames=12, stride=5)


def _sources(lengths: DataFrame) -> DataFrame:
    """Sources of 64 clamped indexes, one after the other."""
    starts = lengths.select("user_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(64).cast("long"))).alias("c"))
    return starts.withColumn("idx", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long")), lambda i: F.least(F.col("c") + i, F.col("n") - 1)))


def _slices_sql(drop: bool) -> str:
    return f"""with src as (select user_id, n, unnest(range(0, n, 64)) as c from {LENGTHS}),
own as (select *, unnest([15, 31, 47]) as s from src),
rows as (select user_id, c, s::bigint as s, k as pos, least(c + 1 + s + k, n - 1) as idx, ((s + 1) // 4 - 4)::bigint as slice_video from own, (select unnest(range(17)) as k)),
seen as (select *, count(distinct idx) over (partition by user_id, c, s) as d from rows)
select user_id, c, s, pos, idx, slice_video, least(greatest(1 + slice_video // 4, 1), 4)::bigint as token_now, least(least(greatest(1 + slice_video // 4, 1), 4) + 1, 4)::bigint as token_next
from seen where slice_video >= 0 {"and d = 17" if drop else ""}"""


def _slices(spark: SparkSession, sf_dir: str, drop: bool) -> DataFrame:
    found = windows.source_slices(_sources(_lengths(spark, sf_dir)), "idx", drop_padded=drop)
    return found.select("user_id", "c", F.col("s").cast("long").alias("s"), F.posexplode("own").alias("pos", "idx"), "slice_video", "token_now", "token_next").withColumn("pos", F.col("pos").cast("long"))


@query(_slices_sql(True))
def fd_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir, drop=True)


@query(_slices_sql(False))
def fd_slices_keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir, drop=False)


@query(f"select w.user_id, w.c, w.pos, w.action_idx, f.event_type, f.value from ({_STRICT}) w join {FRAMES} f on f.user_id = w.user_id and f.frame_idx = w.action_idx")
def gather_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = lookups.gather(windows.strict(episode_lengths(events, 2), LONG), episode_frames(events), "action_idx", ["event_type", "value"])
    return found.select("user_id", "c", "pos", "action_idx", "event_type", "value")


@query(f"select w.user_id, w.c, w.pos, w.valid, coalesce(f.value, 0.0) as value from ({_TAIL}) w left join {FRAMES} f on f.user_id = w.user_id and f.frame_idx = w.action_idx")
def gather_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = lookups.gather(windows.tail_padding(episode_lengths(events, 2), WIDE), episode_frames(events), "action_idx", ["value"], "left")
    return found.select("user_id", "c", "pos", "valid", F.coalesce("value", F.lit(0.0)).alias("value"))


_GRID, _TOLERANCE = 6 * 3600 * 1_000_000, 3600 * 1_000_000


@query(f"""with e as (select user_id, event_id, epoch_us(ts) as us, value from events),
g as (select user_id, unnest(range(lo, hi + 1, {_GRID})) as moment from (select user_id, min(us) as lo, max(us) as hi from e group by user_id)),
near as (select g.user_id, g.moment, e.event_id, e.value, abs(e.us - g.moment) as off from g join e on e.user_id = g.user_id and abs(e.us - g.moment) <= {_TOLERANCE}),
best as (select *, row_number() over (partition by user_id, moment order by off, event_id) as k from near)
select user_id, moment, off, event_id, value from best where k = 1""")
def nearest_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    ends = events.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = ends.select("user_id", F.explode(F.sequence("lo", "hi", F.lit(_GRID))).alias("moment"))
    return lookups.nearest(grid, events, "user_id", "moment", "us", "event_id", _TOLERANCE, ["event_id", "value"])


@query("""with e as (select *, epoch_us(ts) as us from events), p as (select user_id, event_id, us from e where event_type in ('click', 'error')),
n as (select p.*, q.event_id as found, q.value, abs(q.us - p.us) as off, row_number() over (partition by p.event_id order by abs(q.us - p.us), q.event_id) as k
  from p left join e q on q.user_id = p.user_id and q.event_type = 'purchase')
select event_id, off, found, value from n where k = 1""")
def nearest_any_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click or error the nearest purchase of the same user, however far before or after."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    points = events.where(F.col("event_type").isin("click", "error")).select("user_id", F.col("event_id").alias("point_id"), "us")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "us", "value")
    found = asof.nearest(points, bought, "user_id", "us", "us", "event_id", ["event_id", "value"])
    return found.select(F.col("point_id").alias("event_id"), "off", F.col("event_id").alias("found"), "value")


@query(f"""select user_id, n, k, i as pos, round_even(i * (n - 1) / greatest(k - 1, 1), 0)::bigint as idx
from (select *, (round_even(least(greatest(n / 3.0, 4), 24) / 2, 0) * 2)::bigint as k from {LENGTHS}), (select unnest(range(24)) as i) where i < k""")
def frame_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = (F.rint(F.least(F.greatest(F.col("n") / 3.0, F.lit(4)), F.lit(24)) / 2) * 2).cast("long")
    sized = _lengths(spark, sf_dir).withColumn("k", count)
    return sized.select("user_id", "n", "k", F.posexplode(windows.resampled(F.col("n"), F.col("k"))).alias("pos", "idx")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""with r as (select user_id, n, sum(n) over (order by user_id rows unbounded preceding) as high from {LENGTHS})
select event_id, user_id, (high - n)::bigint as low, (event_id - (high - n))::bigint as local_idx from (select distinct event_id from events) e join r on event_id >= high - n and event_id < high""")
def global_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ranges = lookups.number_ranges(episode_lengths(events), "user_id", "n")
    # cut into buckets, so that the range join is one on equal keys; as wide as a range is long on average, so that the ranges
    # of a table fall into about three times as many buckets as there are ranges, however long they are
    width = ranges.agg(F.greatest(F.ceil(F.avg("n")), F.lit(1)).alias("width"))  # one row
    sized = ranges.crossJoin(F.broadcast(width))
    keyed = sized.select("user_id", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width")))).alias("bucket"))
    numbers = events.select("event_id").distinct().crossJoin(F.broadcast(width)).select("event_id", F.floor(F.col("event_id") / F.col("width")).alias("bucket"))
    found = numbers.join(keyed, "bucket").where("event_id >= low and event_id < high")
    return found.select("event_id", "user_id", "low", (F.col("event_id") - F.col("low")).alias("local_idx"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue, windows, gather, normalisation and fan-out into labelled samples, counted by kind."""
    events = table(spark, sf_dir, "events")
    frames = episode_frames(events)
    lengths = lookups.having_all(episode_lengths(events, 2), [events.where("event_type = 'click'").select("user_id").distinct()], ["user_id"])
    gathered = lookups.gather(windows.random_strict_fill(lengths, WIDE), frames, "action_idx", ["value"])
    ranges = events.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = gathered.crossJoin(F.broadcast(ranges)).withColumn("x", normalise(F.col("value"), F.col("low"), F.col("high")))  # ranges: one row
    a, b = (draw(7, "time", side, F.col("user_id")) % WIDE.actions for side in ("a", "b"))
    swapped = F.when(F.col("pos") == a, b).when(F.col("pos") == b, a).otherwise(F.col("pos"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(y).alias("label"), p.alias("pos"), v.alias("x")) for k, y, p, v in (("positive", 1, F.col("pos"), F.col("x")), ("time_swap", 0, swapped, F.col("x")), ("flip", 0, F.col("pos"), -F.col("x")))))
    return scaled.select("user_id", "c", F.inline(kinds)).groupBy("kind", "label").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_windows"), rounded(F.avg("x")).alias("mean_x"), rounded(F.avg(F.col("x") * (F.col("pos") + 1))).alias("mean_placed"))
