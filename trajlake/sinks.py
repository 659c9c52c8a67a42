"""Writers.  Each goes through Spark's commit protocol: a reader sees all of a write or nothing; rewrites go to a new folder, so
that a table is never read and overwritten by one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trajlake.functions.text import moved
from trajlake.operators import lookups
from trajlake.operators.lineage import cut


def write_samples(samples: DataFrame, path: str, by: tuple[str, ...] = ("neg_type", "split", "task")) -> None:
    """Samples in folders by kind, split and task.  Rows keep their own key, so equal names do not overwrite one another."""
    held = [c for c in by if c in samples.columns]
    samples.write.mode("overwrite").partitionBy(*held).parquet(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """One JSON object a line; fields that are null are left out."""
    rows.write.mode("overwrite").json(path)


def write_counted(rows: DataFrame, path: str, **counts: Column) -> dict:
    """Writes Parquet and returns counts of what was written, taken on the way."""
    seen = Observation()
    rows.observe(seen, *(c.alias(n) for n, c in counts.items())).write.mode("overwrite").parquet(path)
    return seen.get


def rewrite_upserted(old: DataFrame, new: DataFrame, key: list[str], path: str, insert: bool = True) -> None:
    """An upsert as JSON lines in a new folder, sorted by key."""
    lookups.upsert(old, new, key, insert).orderBy(*key).write.mode("errorifexists").json(path)


def write_ranges(rows: DataFrame, key: list[str], path: str, part: Column) -> None:
    """Rows in folders by a range of their key (part: a column of it, such as floor(key / 1000)), sorted by key within."""
    rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", *key).write.mode("errorifexists").partitionBy("part").parquet(path)


def upsert_ranges(new: DataFrame, key: list[str], path: str, part: Column, insert: bool = True) -> int:
    """An upsert into what write_ranges() wrote, of the ranges that the new rows touch only: all other files stay as they are.  The names of
    these ranges reach the driver, as those of all folders do anyway.  The merged ranges are written aside first, then each replaces its
    folder as a whole.  Returns how many ranges were rewritten; two writers must not touch one range at a time."""
    spark = new.sparkSession
    placed = new.withColumn("part", part)
    touched = [r[0] for r in placed.select("part").distinct().collect()]
    held = spark.read.parquet(path)
    old = held.where(F.col("part").isin(*touched) if touched else F.lit(False))
    if not insert:
        placed = placed.join(old.select(*key), key, "left_semi")
        touched = [r[0] for r in placed.select("part").distinct().collect()]
        old = old.where(F.col("part").isin(*touched) if touched else F.lit(False))
    if not touched:
        return 0
    placed = placed.withColumn("part", F.col("part").cast(held.schema["part"].dataType))
    merged = cut(lookups.upsert(old, placed.select(*held.columns), key, insert), "merged")
    merged.repartition("part").sortWithinPartitions("part", *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(touched)


def rewrite_one(old: DataFrame, new: DataFrame, key: list[str], path: str) -> bool:
    """As rewrite_upserted(), without inserting; if the old rows have none of the keys, nothing is written.  Whether it was."""
    if old.join(new.select(*key), key, "left_semi").isEmpty():
        return False
    rewrite_upserted(old, new, key, path, insert=False)
    return True


def patched_prefix(old: DataFrame, new: DataFrame, key: str, upto: int) -> DataFrame:
    """New values over the old in rows whose key is below `upto`; all others as they were."""
    return lookups.upsert(old, new.where(F.col(key) < upto), [key], insert=False)


def write_split_manifest(samples: DataFrame, skipped: DataFrame, path: str) -> None:
    """Two manifests below one folder: samples, and what was skipped with the reason."""
    write_manifest(samples, f"{path}/samples")
    write_manifest(skipped.select(*(c for c in skipped.columns if c != "reason"), "reason"), f"{path}/skipped")


def moved_layout(files: DataFrame, path: str = "path") -> DataFrame:
    """old, new: where files go when task/variant/sub becomes split/task/sub; files outside that layout are left out."""
    return files.select(F.col(path).alias("old"), moved(F.col(path)).alias("new")).where("new is not null")


def merge_documents(old: DataFrame, new: DataFrame, key: list[str], path: str) -> None:
    """Whole documents replaced by key, all others kept."""
    lookups.override(old, new, key).write.mode("errorifexists").json(path)


def write_document(entries: DataFrame, name: str, path: str) -> None:
    """A JSON document of one object by name, {name: {field: ...}}, over what was there.  It is read whole by those who use it, so it has
    an entry for a group, never for a row of data; entries are joined into one file."""
    entry = F.struct(F.col(name).cast("string").alias("name"), F.struct(*(c for c in entries.columns if c != name)).alias("entry"))
    whole = entries.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    whole.write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, template: str, *columns: str) -> None:
    """One formatted line a row, in order of the columns."""
    ordered = rows.orderBy(*columns)
    ordered.select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)


def instruction_file(rows: DataFrame, texts: str, prefix: str) -> DataFrame:
    """One prefixed line for each text; a row without texts has the bare prefix."""
    lines = F.when(F.size(texts) > 0, F.col(texts)).otherwise(F.array(F.lit("")))
    return rows.select(F.explode(lines).alias("text")).select(F.concat(F.lit(prefix), "text").alias("value"))


def append_missing(rows: DataFrame, cache: DataFrame, key: list[str], path: str) -> None:
    """Only rows whose key the cache lacks, for one writer; ledger.put_absent() is for several."""
    rows.join(cache.select(*key), key, "left_anti").write.mode("append").parquet(path)


def cache_action(overwrite: Column, pointer_valid: Column, file_exists: Column) -> Column:
    """What to do about one cached file: skip it, repair its pointer, or encode it."""
    return F.when(~overwrite & pointer_valid, "skip").when(~overwrite & file_exists, "repair").otherwise("encode")


def with_feature(info: DataFrame, name: str, dtype: str, shape: list[int]) -> DataFrame:
    """info: a map column `features` of structs (dtype, shape); the feature is added or replaced."""
    own = F.create_map(F.lit(name), F.struct(F.lit(dtype).alias("dtype"), F.array(*map(F.lit, shape)).cast("array<double>").alias("shape")))
    others = F.map_filter("features", lambda k, _: k != name)
    return info.withColumn("features", F.map_concat(others, own))


def split_report(wanted: DataFrame, found: DataFrame, key: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are there, key and reason of those that are not)."""
    return wanted.join(found.select(*key), key, "left_semi"), wanted.join(found.select(*key), key, "left_anti").select(*key, F.lit(reason).alias("reason"))
