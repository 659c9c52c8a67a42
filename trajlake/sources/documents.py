"""Documents of settings and statistics: an object by name, as JSON or YAML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.session import importable


def _as_json(text: str | None) -> str | None:
    """A YAML text as JSON; JSON is YAML, but is not sent through here."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML documents need the package yaml") from e
    return None if text is None else json.dumps(yaml.safe_load(text), default=str)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, document (JSON text) of each file; those that end in .yaml or .yml are turned into JSON, a whole file in a task."""
    importable(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("document"))
    yaml_ = F.lower("file").rlike(r"\.ya?ml$")
    convert = F.pandas_udf(lambda s: s.map(_as_json, na_action="ignore"), "string")
    return files.select("file", F.when(yaml_, convert(F.when(yaml_, F.col("document")))).otherwise(F.col("document")).alias("document"))


def read_entries(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """name and the fields (DDL) of every entry of the documents at a path, each parsed once.  No rows where there is no file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"name string, {fields}")
    entries = F.from_json("document", T.MapType(T.StringType(), T.StructType.fromDDL(fields)))
    return read_documents(spark, path).select(F.explode(entries).alias("name", "entry")).select("name", "entry.*")


def with_entry(rows: DataFrame, name: Column, entries: DataFrame, fields: list[str], missing_ok: bool = False) -> DataFrame:
    """rows with the fields of the entry of their name, joined; a name without an entry fails, or has nulls if that is allowed."""
    own = entries.select(F.col("name").alias("__name"), F.lit(True).alias("__there"), *fields)
    joined = rows.withColumn("__of", name).join(own, F.col("__of") == F.col("__name"), "left")
    if not missing_ok:
        lacking = F.raise_error(F.concat(F.lit("no entry of "), F.coalesce(F.col("__of").cast("string"), F.lit("null"))))
        joined = joined.withColumns({f: F.when(F.col("__there"), F.col(f)).otherwise(lacking.cast(entries.schema[f].dataType)) for f in fields})
    return joined.drop("__of", "__name", "__there")
