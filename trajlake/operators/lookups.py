"""Joins and lookups: gathers, nearest in time, ranges, priorities, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.text import strip
from trajlake.operators.ranking import running_sum


def having_all(first: DataFrame, others: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first whose key is in all of the others: semi joins, so nothing multiplies."""
    return reduce(lambda a, b: a.join(b.select(*key), key, "left_semi"), others, first)


def missing(first: DataFrame, others: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """key, reason: for each of the others, the rows of the first that it lacks."""
    parts = [first.join(b.select(*key), key, "left_anti").select(*key, F.lit(name).alias("reason")) for name, b in others.items()]
    return reduce(DataFrame.unionByName, parts)


def gather(windows: DataFrame, frames: DataFrame, index: str, columns: list[str], how: str = "inner") -> DataFrame:
    """Columns of the frame that each index names; order and repeats stay."""
    return windows.join(frames.select("user_id", F.col("frame_idx").alias(index), *columns), ["user_id", index], how)


def nearest(points: DataFrame, events: DataFrame, group: str, at: str, when: str, tie: str, tolerance: int, columns: list[str]) -> DataFrame:
    """Of each point, the event of its group nearest in time within the tolerance (ties: the lower `tie`).  Times are cut into buckets
    as long as the tolerance; a point looks into three, so the join is on equal keys."""
    width = F.lit(tolerance)
    asked = points.withColumn("bucket", F.explode(F.array(*(F.floor(F.col(at) / width) + d for d in (-1, 0, 1)))))
    held = events.select(group, F.floor(F.col(when) / width).alias("bucket"), F.col(when).alias("when"), F.col(tie).alias("tie"), *(F.col(c).alias(f"event_{c}") for c in columns))
    off = F.abs(F.col("when") - F.col(at))
    near = asked.join(held, [group, "bucket"]).withColumn("off", off).where(F.col("off") <= tolerance)
    best = F.min_by(F.struct("tie", "off", *(f"event_{c}" for c in columns)), F.struct("off", "tie"))
    return near.groupBy(*points.columns).agg(best.alias("best")).select(*points.columns, F.col("best.off").alias("off"), *(F.col(f"best.event_{c}").alias(c) for c in columns))


def gather_strict(windows: DataFrame, frames: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """As gather(); an index without a frame fails."""
    found = gather(windows, frames.withColumn("__there", F.lit(True)), index, [*columns, "__there"], "left")
    there = F.when(F.col("__there"), F.col(columns[0])).otherwise(F.raise_error(F.concat(F.lit("no frame "), F.col(index).cast("string"))).cast(frames.schema[columns[0]].dataType))
    return found.withColumn(columns[0], there).drop("__there")


def field_or(held: Column, name: str, default: Column) -> Column:
    """A field of a map; the default only if the map has no such field: one that is there and null stays null."""
    return F.when(F.coalesce(F.map_contains_key(held, name), F.lit(False)), F.element_at(held, name)).otherwise(default)


def resolve_resources(episodes: DataFrame, embeddings: DataFrame, texts: DataFrame, task: str, episode: str) -> DataFrame:
    """episodes with `embedding` and `text`, paths of their resources; both others have columns task, name, path.  A task that has exactly
    one of each shares them among its episodes; else each comes by the episode's name, or else by the task's.  What lacks one is dropped."""
    out = episodes
    for kind, files in (("embedding", embeddings), ("text", texts)):
        alone = files.groupBy(task).agg(F.count("*").alias(f"{kind}_files"), F.min("path").alias(f"{kind}_only"))
        named = files.select(task, F.col("name").alias(episode), F.col("path").alias(f"{kind}_own"))
        shared = files.where(F.col("name") == F.col(task)).select(task, F.col("path").alias(f"{kind}_task"))
        out = out.join(alone, task, "left").join(named, [task, episode], "left").join(shared, task, "left")
    pair = (F.col("embedding_files") == 1) & (F.col("text_files") == 1)
    chosen = {k: F.when(F.coalesce(pair, F.lit(False)), F.col(f"{k}_only")).otherwise(F.coalesce(f"{k}_own", f"{k}_task")) for k in ("embedding", "text")}
    return out.select(*episodes.columns, *(c.alias(k) for k, c in chosen.items())).where("embedding is not null and text is not null")


def first_of(*candidates: Column) -> Column:
    """The first that is not null and not blank."""
    return F.coalesce(*(F.when(strip(c) != "", c) for c in candidates))


def first_path(rows: DataFrame, key: list[str], candidates: list[Column], files: DataFrame, path: str = "path", name: str = "found") -> DataFrame:
    """rows with the first of their candidate paths that is among the files; null if none is.  `key` names a row."""
    asked = rows.select(*key, F.posexplode(F.array(*candidates)).alias("prio", path))
    hits = asked.join(files.select(path).distinct(), path).groupBy(*key).agg(F.min_by(path, "prio").alias(name))
    return rows.join(hits, key, "left")


def with_length(rows: DataFrame, lengths: DataFrame, key: str, length: str, default: Column | None = None) -> DataFrame:
    """rows with the length of their key; a key without one has the default, or null."""
    joined = rows.join(lengths.select(key, length), key, "left")
    return joined if default is None else joined.withColumn(length, F.coalesce(length, default))


def upsert(old: DataFrame, new: DataFrame, key: list[str], insert: bool = True) -> DataFrame:
    """Values of the new rows over the old; keys that only the new ones have come in if `insert`."""
    values = [c for c in old.columns if c not in key]
    marked = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in values), F.lit(True).alias("given"))
    joined = old.withColumn("held", F.lit(True)).join(marked, key, "full" if insert else "left")
    return joined.select(*key, *(F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def override(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Whole rows of the new in place of old ones of the same key; all other old rows."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def number_ranges(counts: DataFrame, order: str, count: str) -> DataFrame:
    """low, high: the range of global numbers that each row's items have, in order of a numeric column."""
    summed = running_sum(counts, F.col(order), F.col(count), name="high")
    return summed.withColumn("low", F.col("high") - F.col(count))
