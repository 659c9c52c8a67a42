"""The given tables, and episodes as views of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.operators.ranking import positions_within
from trajlake.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episode_frames(events: DataFrame) -> DataFrame:
    """One row per frame: user_id is the episode, frame_idx counts from 0 in order of time.  A very long episode is not one task."""
    rows = events.select("user_id", "ts", "event_id", "event_type", "value")
    placed = positions_within(rows, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_id", name="frame_idx")
    return placed.select("user_id", "frame_idx", "ts", "event_id", "event_type", "value")


def episode_lengths(events: DataFrame, least: int = 0) -> DataFrame:
    """user_id, n: no frame numbers are needed for it, so no sort."""
    return events.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
