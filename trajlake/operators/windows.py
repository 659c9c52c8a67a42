"""Index windows over episodes: index arithmetic on one row per episode, then one explode; nothing is shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.keyed import below


@dataclass(frozen=True)
class Spec:
    """frames: video frames of a window; ratio: actions per video frame; stride: source frames per action."""

    frames: int
    ratio: int
    stride: int

    @property
    def actions(self) -> int:
        return self.frames * self.ratio

    @property
    def span(self) -> int:
        return self.actions * self.stride


def stepped(first: Column, last: Column, step: Column) -> Column:
    """first, first + step, ... up to last; null, which explodes to nothing, where last is before first."""
    return F.when(last >= first, F.sequence(first, F.greatest(first, last), step))


def greatest_start(n: Column, s: Spec) -> Column:
    """The last start that leaves a valid prefix of two video frames; null if there is none."""
    if s.actions < 2 * s.ratio:
        return F.lit(None).cast("long")
    last = n - 1 - max(min(2, s.frames), 2) * s.ratio * s.stride
    return F.when(last >= 0, last)


def strict_start(n: Column, s: Spec, *key: Column | str | int) -> Column:
    room = n - s.span
    return F.when(room <= 0, F.lit(0)).otherwise(below(F.greatest(room, F.lit(1)), *key)).cast("long")


def free_start(n: Column, s: Spec, *key: Column | str | int) -> Column:
    """Anywhere with a valid prefix; null if there is no such place."""
    most = greatest_start(n, s)
    return F.when(most.isNotNull(), below(F.coalesce(most, F.lit(0)) + 1, *key)).cast("long")


def action_indexes(c: Column, n: Column, s: Spec, clamp: bool = True) -> Column:
    """Indexes of the actions after a start; beyond the end they stay on the last frame if clamped."""
    at = F.sequence(F.lit(1).cast("long"), F.lit(s.actions).cast("long"))
    return F.transform(at, lambda i: F.least(c + i * s.stride, n - 1) if clamp else c + i * s.stride)


def exploded(starts: DataFrame, indexes: Column, s: Spec, *more: Column) -> DataFrame:
    """One row per action of each window: pos, action_idx, and video_pos where the action ends a video frame's stretch."""
    out = starts.select("*", F.posexplode(indexes).alias("pos", "action_idx")).withColumn("pos", F.col("pos").cast("long"))
    video = F.when((F.col("pos") + 1) % s.ratio == 0, F.floor(F.col("pos") / s.ratio))
    return out.withColumn("video_pos", video.cast("long")).select("*", *more)


def strict(lengths: DataFrame, s: Spec, seed: int = 7) -> DataFrame:
    """Start anywhere the whole window fits, else at 0 with a clamped tail."""
    starts = lengths.withColumn("c", strict_start(F.col("n"), s, seed, "strict", F.col("user_id")))
    return exploded(starts, action_indexes(F.col("c"), F.col("n"), s), s)


def tail_padding(lengths: DataFrame, s: Spec, seed: int = 7) -> DataFrame:
    """Start anywhere with a valid prefix, ideal indexes with a validity flag; episodes without such a start are left out."""
    starts = lengths.withColumn("c", free_start(F.col("n"), s, seed, "tail", F.col("user_id"))).where("c is not null")
    return exploded(starts, action_indexes(F.col("c"), F.col("n"), s, clamp=False), s, (F.col("action_idx") < F.col("n")).alias("valid"))


def random_strict_fill(lengths: DataFrame, s: Spec, seed: int = 7) -> DataFrame:
    """Start anywhere with a valid prefix and a clamped tail; where there is no such start, as strict()."""
    free = free_start(F.col("n"), s, seed, "fill", F.col("user_id"))
    starts = lengths.withColumn("fallback", free.isNull()).withColumn("c", F.coalesce(free, strict_start(F.col("n"), s, seed, "strict", F.col("user_id"))))
    return exploded(starts, action_indexes(F.col("c"), F.col("n"), s), s)


def tiled(lengths: DataFrame, s: Spec, start: int = 0) -> DataFrame:
    """Windows one after the other, the last ones clamped."""
    some = lengths.where(F.col("n") > start)
    starts = some.select("*", F.explode(stepped(F.lit(start).cast("long"), F.col("n") - 1, F.lit(s.span).cast("long"))).alias("c"))
    return exploded(starts, action_indexes(F.col("c"), F.col("n"), s), s)


def overlapping(lengths: DataFrame, ratio: int, stride: int, actions: int = 9) -> DataFrame:
    """Three video frames and the actions from the third on, unclamped; kind says which, starts are 2 * ratio * stride apart."""
    last = F.col("n") - 1 - (3 * ratio + actions - 1) * stride
    starts = lengths.withColumn("last", last).where("last >= 0").select("user_id", "n", F.explode(stepped(F.lit(0).cast("long"), F.col("last"), F.lit(2 * ratio * stride).cast("long"))).alias("c"))
    video = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(F.lit("video").alias("kind"), (k - 1).cast("long").alias("pos"), (F.col("c") + k * ratio * stride).alias("idx")))
    action = F.transform(F.sequence(F.lit(0), F.lit(actions - 1)), lambda k: F.struct(F.lit("action").alias("kind"), k.cast("long").alias("pos"), (F.col("c") + (3 * ratio + k) * stride).alias("idx")))
    return starts.select("user_id", "n", "c", F.inline(F.concat(video, action)))


def latent(lengths: DataFrame, frames: int, stride: int, seed: int = 7) -> DataFrame:
    """Frames after a start and the latent rows between them; latent rows are one fewer than frames."""
    n = F.col("n")
    room = n - frames * stride
    starts = lengths.where("n >= 3").withColumn("c", F.when(room <= 0, F.lit(0)).otherwise(below(F.greatest(room, F.lit(1)), seed, "latent", F.col("user_id"))).cast("long"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))
    pairs = F.transform(at, lambda i: F.struct(i.alias("pos"), F.least(F.col("c") + (i + 1) * stride, n - 1).alias("video_idx"), F.least(F.col("c") + i * stride, n - 2).alias("action_idx")))
    return starts.select("user_id", "n", "c", F.inline(pairs))


def source_slices(sources: DataFrame, indexes: str, width: int = 17, step: int = 16, first: int = 15, drop_padded: bool = True, frames: int = 16) -> DataFrame:
    """Slices of sources of clamped indexes: s = first, first + step, ...; those that repeat an index go if `drop_padded`.
    slice_video is the video frame that s belongs to; token_now and token_next are the token blocks of the slice and the one after."""
    last = F.size(indexes) - width
    starts = sources.withColumn("last", last).where(F.col("last") >= first).select("*", F.explode(stepped(F.lit(first), F.col("last"), F.lit(step))).alias("s"))
    own = starts.withColumn("own", F.slice(indexes, F.col("s") + 1, F.lit(width)))
    if drop_padded:
        distinct = F.size(F.array_distinct("own")) == width  # indexes never fall, so equal ones are neighbours
        own = own.where(distinct)
    begin = F.floor((F.col("s") + 1) / 4) - 4
    now = F.least(F.greatest(1 + F.floor(begin / 4), F.lit(1)), F.lit(4))
    own = own.where(((F.col("s") + 1) % 4 == 0) & (begin >= 0) & (begin + 4 <= frames))
    return own.select("*", begin.cast("long").alias("slice_video"), now.cast("long").alias("token_now"), F.least(now + 1, F.lit(4)).cast("long").alias("token_next"))


def even_count(n: Column, rate: Column, target: float, least: int = 4, most: int = 768) -> Column:
    """How many of n frames at a rate to take for a target rate: a multiple of 2 between `least` and the smaller of `most` and n."""
    low, high = -(-least // 2) * 2, F.floor(F.least(F.lit(most), n) / 2) * 2
    return (F.rint(F.least(F.greatest(n / rate * target, F.lit(low)), high) / 2) * 2).cast("long")


def checked_even_count(n: Column, rate: Column, target: float, least: int = 4, most: int | None = None, asked: Column | None = None, factor: int = 2) -> Column:
    """How many of n frames to take: as asked, or else for a target rate, between `least` and `most` (768 or all frames if it is not given),
    as a multiple of `factor`.  Fails unless that is between the factor and n; a rate and a number asked for exclude one another."""
    near = lambda x: (F.rint(x / factor) * factor).cast("long")
    low = -(-least // factor) * factor
    high = F.lit(most // factor * factor) if most is not None else F.floor(F.least(F.lit(768), n) / factor) * factor
    by_rate = near(F.least(F.greatest(n / rate * target, F.lit(low)), high))
    count = by_rate if asked is None else F.when(asked.isNotNull(), near(asked)).otherwise(by_rate)
    wrong = F.concat(F.lit(f"frames should be in {factor} .. "), n.cast("string"), F.lit(", not "), count.cast("string"))
    return F.when((count >= factor) & (count <= n), count).otherwise(F.raise_error(wrong).cast("long"))


#: Names of the ways to sample a window, as sample() takes them.
MODES = {"strict": strict, "tail_padding": tail_padding, "random_strict_fill": random_strict_fill, "sequential": tiled}


def sample(lengths: DataFrame, s: Spec, mode: str, **options: int) -> DataFrame:
    """Windows by the name of their mode, written in any case, with - or _."""
    name = mode.strip().lower().replace("-", "_")
    if name not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    return MODES[name](lengths, s, **options)


def resampled(n: Column, count: Column) -> Column:
    """`count` indexes evenly over 0 .. n - 1, rounded half to even."""
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.rint(i * (n - 1) / F.greatest(count - 1, F.lit(1))).cast("long"))
