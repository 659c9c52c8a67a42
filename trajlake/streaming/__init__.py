"""Structured Streaming: incremental cache filling and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fill_cache(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], key: list[str], cache_path: str, checkpoint: str) -> StreamingQuery:
    """Encodes what the cache lacks, batch by batch, and ends when nothing is left; a restart goes on where it stopped.  Of the cache, only
    what lies between the batch's least and greatest key is read (row groups apart from it are skipped)."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        if spark._jvm.org.apache.hadoop.fs.Path(cache_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(cache_path)):
            low, high = new.agg(F.min(key[0]), F.max(key[0])).first()
            held = spark.read.parquet(cache_path).where(F.col(key[0]).between(F.lit(low), F.lit(high)))
            new = new.join(held.select(*key), key, "left_anti")
        encode(new).write.mode("append").parquet(cache_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, when: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of `value` by time window; rows later than `late` are dropped.  Times without zone are taken as UTC."""
    timed = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    counted = timed.groupBy(F.window(when, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), *by, "n", "total")
