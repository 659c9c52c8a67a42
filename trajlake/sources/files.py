"""Catalogues of files: listings, leaf folders, lines with their numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, stem, extension, parent, size: no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path", F.col("length").alias("size"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size").select("path", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.regexp_extract("name", r"\.([^.]*)$", 1).alias("extension"), F.regexp_replace("path", r"/[^/]*$", "").alias("parent"), "size")


def pruned(files: DataFrame, skip: tuple[str, ...] = ("videos", "instructions"), numeric: bool = True) -> DataFrame:
    """Files outside skipped, hidden and backup folders, and of whole numbers as names if `numeric`."""
    out = files.where(~F.col("parent").rlike(rf"/({'|'.join(skip)}|\.[^/]+|[^/]*_bak)(/|$)"))
    return out.where(F.col("stem").rlike("^[0-9]+$")) if numeric else out


def collected(spark: SparkSession, roots: list[str], pattern: str, children: tuple[str, ...] = ()) -> DataFrame:
    """Files of a pattern below several roots, each with its root, sorted by path; children: only below folders of these names."""
    out = None
    for root in roots:
        found = listing(spark, root, pattern)
        found = found.where(F.element_at(F.split("parent", "/"), -1).isin(*children)) if children else found
        own = found.select(F.lit(root).alias("root"), "*")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no root")
    return out.orderBy("path")


def saved(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What was saved there before, however old; else what is made now, saved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        make().write.parquet(path)
    return spark.read.parquet(path)


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """total_episodes, total_frames, fps of a data set: its description is read, none of its rows."""
    return spark.read.schema("total_episodes long, total_frames long, fps double").option("multiLine", True).json(f"{root}/meta/info.json")


def sections(document: Column, *paths: str) -> list[Column]:
    """Parts of a nested JSON document, by dotted path, each under its last name; null where there is none."""
    return [F.get_json_object(document, f"$.{p}").alias(p.rsplit(".", 1)[-1]) for p in paths]


def leaf_folders(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Folders that hold every one of the required folders; none of them lies within another such folder."""
    inside = files.select(F.regexp_replace("parent", r"/[^/]*$", "").alias("folder"), F.element_at(F.split("parent", "/"), -1).alias("child"))
    found = inside.where(F.col("child").isin(*required)).groupBy("folder").agg(F.count_distinct("child").alias("n")).where(F.col("n") == len(required)).select("folder")
    # a search from above stops at the first such folder: what lies below one is left out
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/")) - 1), lambda k: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), k), "/"))
    nested = found.select("folder", F.explode(above).alias("upper")).join(found.select(F.col("folder").alias("upper")), "upper", "left_semi").select("folder")
    return found.join(nested, "folder", "left_anti")


def episode_catalog(files: DataFrame, modalities: tuple[str, ...]) -> DataFrame:
    """split, task, episode and one path for each modality, from .../split/task/modality/episode.ext; an episode needs them all."""
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -4).alias("split"), F.element_at(parts, -3).alias("task"), F.element_at(parts, -2).alias("modality"), F.col("stem").alias("episode"), "path")
    wide = named.groupBy("split", "task", "episode").pivot("modality", list(modalities)).agg(F.min("path"))
    return wide.dropna(subset=list(modalities)).select("split", "task", "episode", *(F.col(m).alias(f"{m}_path") for m in modalities))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no from 0, line: each file is read whole, so that numbers hold whatever the splits."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\n$", "").alias("text"))
    return whole.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
