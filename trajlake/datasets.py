"""Data sets by the name of their type: a configuration becomes a DataFrame of samples."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.operators import lookups, sampling, windows
from trajlake.sources import episode_frames, episode_lengths, located_manifest, table

Builder = Callable[..., DataFrame]
DEFAULT = "episodes"
_BUILDERS: dict[str, Builder] = {}


def builder(name: str) -> Callable[[Builder], Builder]:
    """Registers a function of (spark, *, val, and its own parameters) as a type."""

    def register(f: Builder) -> Builder:
        _BUILDERS[name] = f
        return f

    return register


def create(spark: SparkSession, config: dict, val: bool = False) -> DataFrame:
    """The data set of config["dataset"]["type"] (episodes if there is none).  Its parameters are those of `common`, of `dataset`, and of
    dataset["params"], of which the later win; a name that the type does not take fails if it comes from `dataset`, and is left out if from
    `common`.  val: for validation, without augmentation."""
    own = dict(config.get("dataset", {}))
    kind = own.pop("type", None) or DEFAULT
    if kind not in _BUILDERS:
        raise ValueError(f"type {kind!r} is none of {', '.join(sorted(_BUILDERS))}")
    own |= own.pop("params", None) or {}
    known = inspect.signature(_BUILDERS[kind]).parameters
    unknown = [k for k in own if k not in known]
    if unknown:
        raise ValueError(f"{kind} takes no {', '.join(unknown)}")
    shared = {k: v for k, v in config.get("common", {}).items() if k in known}
    return _BUILDERS[kind](spark, **shared | own, val=val)


@builder("episodes")
def episodes(spark: SparkSession, *, dataset_dir: str, val: bool = False, num_video_frames: int = 8, video_action_freq_ratio: int = 2, global_downsample_rate: int = 1, sampling_mode: str = "strict", task_name: str | None = None, max_episodes: int | None = None, values: bool = True, image_aug: bool = False, seed: int = 7) -> DataFrame:
    """A window of each episode, with the value of each frame and whether it is augmented.  task_name: only frames of one task; max_episodes: the
    first ones in hashed order (a limit that is asked for)."""
    events = table(spark, dataset_dir, "events")
    events = events if task_name is None else events.where(F.col("event_type") == task_name)
    lengths = episode_lengths(events, 2)
    if max_episodes is not None:
        lengths = lengths.orderBy(sampling.draw(seed, "episodes", F.col("user_id")), "user_id").limit(max_episodes)
    spec = windows.Spec(num_video_frames, video_action_freq_ratio, global_downsample_rate)
    found = windows.sample(lengths, spec, sampling_mode)
    if values:
        found = lookups.gather(found, episode_frames(events), "action_idx", ["value"], "left")
    return found.withColumn("augmented", F.lit(image_aug and not val))


@builder("manifest")
def manifest(spark: SparkSession, *, dataset_dir: str, val: bool = False, manifest_name: str = "manifest.jsonl", label: int | None = None, split: str | None = None) -> DataFrame:
    """The entries of a manifest in order of the file (number), those of a label or split only."""
    rows = located_manifest(spark, f"{dataset_dir}/{manifest_name}")
    rows = rows if label is None else rows.where(F.col("label") == label)
    return rows if split is None else rows.where(F.col("split") == split)


@builder("vectors")
def vectors(spark: SparkSession, *, dataset_dir: str, val: bool = False, task_name: str | None = None, normalise: bool = True) -> DataFrame:
    """Vectors by task; with `normalise` each value within the range of its dimension over all tasks."""
    rows = table(spark, dataset_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("task"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    if normalise:
        ranges = rows.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))  # a row for each dimension
        rows = rows.join(F.broadcast(ranges), "dim").withColumn("x", (F.col("x") - F.col("low")) / F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))).drop("low", "high")
    return rows if task_name is None else rows.where(F.col("task") == task_name)
