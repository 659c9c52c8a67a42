"""Write-once caches that several writers fill at a time: folders of Parquet, and a ledger of those that count.

A writer writes what the cache lacks to a folder of its own and then publishes it by one small file whose number is the next free one.
That file is made as a whole or not at all, and never over another; who comes second looks into what was published meanwhile where its
range of keys meets its own, takes those keys out of its folder, and tries the number after.  So every key has one row, no lock can be
left behind, and a writer that dies leaves a folder that nobody reads."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    """A published folder, with the range of its first key column, as text that SQL reads back."""

    folder: str
    low: str
    high: str
    rows: int


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with its content in one step; False if it is there already."""
    target, fs = _path(spark, path)
    source = _path(spark, f"{path}.{uuid.uuid4().hex}.part")[0]
    out = fs.create(source)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":  # there a rename may replace a file
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(source))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, none)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(source, False)


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What is published, in order."""
    folder, fs = _path(spark, f"{path}/ledger")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().toString() for s in fs.listStatus(folder) if re.fullmatch(r"\d{9}\.json", s.getPath().getName()))
    return [Entry(**json.loads(r.value)) for r in spark.read.text(names, wholetext=True).select("value", F.input_file_name().alias("f")).orderBy("f").collect()] if names else []


def published(spark: SparkSession, path: str, some: list[Entry] | None = None) -> DataFrame | None:
    """The rows of the cache, or of some of its folders; None if there is none."""
    held = entries(spark, path) if some is None else some
    return spark.read.parquet(*(f"{path}/data/{e.folder}" for e in held)) if held else None


def _write(rows: DataFrame, path: str, key: str) -> Entry:
    seen, folder = Observation(), uuid.uuid4().hex
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows.observe(seen, F.count("*").alias("rows"), text(F.min(key)).alias("low"), text(F.max(key)).alias("high")).write.parquet(f"{path}/data/{folder}")
    got = seen.get
    return Entry(folder, got["low"], got["high"], got["rows"])


def _meet(a: Entry, b: Entry, number: bool) -> bool:
    value = float if number else str
    return value(a.low) <= value(b.high) and value(b.low) <= value(a.high)


def put_absent(rows: DataFrame, key: list[str], path: str, encode: Callable[[DataFrame], DataFrame] = lambda x: x, tries: int = 20) -> int:
    """Adds the rows whose key the cache lacks, after encode() (which keeps the key columns), and returns how many.  Of several rows with
    one key in `rows` one is taken; rows with a null in the key are left out.  Ranges are compared on the first column of the key."""
    spark = rows.sparkSession
    number = dict(rows.dtypes)[key[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    seen = entries(spark, path)
    new = rows.dropna(subset=key).dropDuplicates(key)
    held = published(spark, path, seen)
    own = _write(encode(new if held is None else new.join(held.select(*key), key, "left_anti")), path, key[0])
    for _ in range(tries):
        if not own.rows:
            return 0
        if create(spark, f"{path}/ledger/{len(seen):09d}.json", json.dumps(asdict(own))):
            return own.rows
        now = entries(spark, path)
        others, seen = [e for e in now[len(seen) :] if _meet(e, own, number)], now
        if others:
            mine = published(spark, path, [own])
            own = _write(mine.join(published(spark, path, others).select(*key), key, "left_anti"), path, key[0])
    raise RuntimeError(f"{path}: other writers were faster {tries} times")
