"""Statistics kept up to date: only files that are new are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trajlake.operators import statistics as st


def keep_statistics(stream: DataFrame, values: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Partials (n, mean, m2, low, high) of each new file, by `by`, as a folder for each batch.  stream: of files; values(): its rows as
    values x with the columns of `by` and `file`.  A batch that runs again, after a failure or from an older checkpoint, overwrites its own
    folder with the same, so nothing counts twice."""

    def add(batch: DataFrame, number: int) -> None:
        st.partial_moments(values(batch), "file", *by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    named = stream.withColumn("file", F.col("_metadata.file_path"))
    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """n, mean, low, high, std over all files so far."""
    return st.merged_moments(spark.read.parquet(path), *by)


def unreadable(spark: SparkSession, path: str, expected: int, *by: str) -> DataFrame:
    """file, n: files that lack some of the `expected` groups, such as dimensions."""
    held = spark.read.parquet(path).select("file", *by).distinct()
    return held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") != expected)
