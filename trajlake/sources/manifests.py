"""Manifests: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of all manifest kinds; those that a kind lacks are null.
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "split", "task", "episode", "instruction_text", "neg_type", "source_sample_relpath", "swap_partner_task", "swap_partner_source")]
    + [T.StructField(n, T.LongType()) for n in ("label", "instruction_idx", "condition_frame_idx", "total_frames", "slice_action_start", "slice_video_start", "predicted_token_time_slice", "predicted_token_time_slice_future")]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("video_indices", "action_indices")]
)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, offset (the byte at which a line begins), line_no (from 0 in its file), number (from 0 over all files, by name), line.

    Files are read in splits of any size and counted split by split; what a split adds to the next ones is one row.  Lines end with a
    newline; a carriage return before it is not part of the line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    size = F.octet_length("value") + 1
    sums = rows.groupBy("file", "block").agg(F.sum(size).alias("bytes"), F.count("*").alias("lines"))
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.groupBy("file").agg(F.sum("lines").alias("whole"))
    # a row for each file, and a row for each split
    files = files.select("file", F.coalesce(F.sum("whole").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    before = sums.select("file", "block", F.coalesce(F.sum("bytes").over(own), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("lines").over(own), F.lit(0)).alias("lines_before")).join(files, "file")
    inside = Window.partitionBy("file", "block").orderBy("at")  # what a split holds
    placed = rows.withColumns({"upto": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size, "place": F.row_number().over(inside) - 1}).join(before, ["file", "block"])
    line_no = F.col("lines_before") + F.col("place")
    return placed.select("file", (F.col("bytes_before") + F.col("upto")).alias("offset"), line_no.alias("line_no"), (F.col("earlier") + line_no).alias("number"), F.regexp_replace("value", "\r$", "").alias("line"))


def located_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """A manifest with file, offset, line_no and number of each entry, to be sorted by number where order counts.  Blank lines are skipped; a
    malformed line fails the read, with its file, line and offset."""
    whole = T.StructType([*schema.fields, T.StructField("__malformed", T.StringType())])
    rows = located_lines(spark, path).where(F.btrim("line") != "")
    parsed = rows.withColumn("entry", F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__malformed"}))
    place = F.concat(F.lit("malformed line "), (F.col("line_no") + 1).cast("string"), F.lit(" at byte "), F.col("offset").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "), F.substring("line", 1, 80))
    sound = F.col("entry.__malformed").isNull() & F.col("entry").isNotNull()
    checked = parsed.withColumn("number", F.when(sound, F.col("number")).otherwise(F.raise_error(place).cast("long")))
    return checked.select("file", "offset", "line_no", "number", *(F.col(f"entry.{f.name}").alias(f.name) for f in schema.fields))
