"""Helpers shared by the operators: columnar text in numpy, hashing of spans, materialised intermediates."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Hashes of spans are taken modulo this prime, 2 ** 31 - 1: products and long sums of residues stay below 2 ** 64.
PRIME = 0x7FFFFFFF
#: Two bases for each of two independent hashes.
BASES = ((0x2545F491, 0x5851F42D), (0x1B873593, 0x4C957F2D))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a bijection), so that any of their bits can choose a bucket."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def residue(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.minimum(x, x - U64(PRIME))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo PRIME; the table is kept and grows when a longer one is asked for."""
    have = _powers.get(base, np.ones(1, np.uint32))
    while len(have) < n:
        have = np.concatenate([have, residue(have * U64(pow(base, len(have), PRIME))).astype(np.uint32)])
    _powers[base] = have
    return have[:n]


class SpanHash:
    """62-bit hashes of any spans of a sequence of bytes, scrambled: each is two polynomials modulo a prime, from running sums of the
    values times powers of a base.  (Modulo 2 ** 64 there are texts, such as Thue-Morse words, that clash for every base.)  `second`
    asks for a hash independent of the first."""

    def __init__(self, buf: np.ndarray, second: bool = False):
        values = buf.astype(U64) + U64(1)
        self.start(values, values, second)

    def start(self, a: np.ndarray, b: np.ndarray, second: bool) -> None:
        """a, b: what each base's polynomial sums, below 2 ** 31."""
        self.parts = []
        for base, values in zip(BASES[second], (a, b)):
            terms = values * powers(base, len(values))
            if len(terms) >> 24 or a is not b:
                terms = residue(terms)
            sums = np.zeros(len(terms) + 1, U64)
            np.cumsum(terms, out=sums[1:])
            self.parts.append((sums, pow(base, -1, PRIME)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = (residue(residue(sums[ends] - sums[starts]) * powers(inverse, len(sums))[starts]) for sums, inverse in self.parts)
        return mix(high << U64(31) | low)


class WordHash(SpanHash):
    """Hashes of any runs of words or lines, given a hash of each."""

    def __init__(self, words: np.ndarray, second: bool = False):
        self.start(residue(words >> U64(2) & U64(PRIME)), residue(words >> U64(33)), second)


def text_slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets) of runs of whole rows of about `limit` bytes, `rows` at most; null is empty.
    No more than so many rows are copied at a time."""
    whole = batch.column(batch.schema.get_field_index(name))
    for begin in range(0, len(whole), rows):
        column = whole.slice(begin, rows).fill_null("").cast(pa.large_string())
        buffers, n = column.buffers(), len(column)
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield begin + first, begin + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows at most."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, at, "right") - 1


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of bytes other than ASCII white space; no run crosses rows."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[buf]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, rows_of(offsets, starts)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the parts between newlines; an empty row has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    at = rows_of(offsets, breaks)
    rows = np.concatenate([np.arange(len(offsets) - 1), at])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    ends_rows = np.concatenate([at, np.arange(len(offsets) - 1)])
    ends = np.concatenate([breaks, offsets[1:]])
    return starts, ends[np.lexsort((ends, ends_rows))], rows


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0] + lengths[0]], flat[starts[1]: ...] ... as one array."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(total)]


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]."""
    running = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


#: What operators keep in a Python worker from one task to the next, by name.
KEPT: dict[str, dict] = {}


def forget_others(keep: tuple[str, ...]) -> None:
    for name, kept in KEPT.items():
        if name not in keep:
            kept.clear()


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], *keep: str) -> Callable[[Iterator], Iterator]:
    """A task's function that drops at its start what other operators keep in the worker, all but `keep`, and gives freed memory back at its
    end: workers outlive their tasks, and an idle one still counts as memory of its executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one under the warehouse where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm_shared"


@contextmanager
def _shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go at its end (Spark keeps them till the driver collects garbage)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them back: lineage ends there, so a lost executor costs one
    stage at most."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_let_go(spark):
        frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def discard(frame: DataFrame) -> None:
    """Removes what materialize() wrote; only for frames that nothing will read again."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.__dict__["_folder"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(frame: DataFrame, name: str, *keys: str) -> DataFrame:
    """As materialize(), but as a table bucketed by the keys: joins and groupings on them move only what meets these rows."""
    return bucketed(frame.repartition(partitions(frame.sparkSession), *keys), name, *keys)


def bucketed(frame: DataFrame, name: str, *keys: str) -> DataFrame:
    """As dealt(), without moving rows before: for a frame whose partitions have few keys each."""
    spark, n = frame.sparkSession, partitions(frame.sparkSession)
    table = f"{name}_{uuid.uuid4().hex}"
    with _shuffles_let_go(spark):
        frame.write.bucketBy(n, *keys).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # the name only: the files stay, and the frame knows them and their buckets
    return out


def plain_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that sees extra columns under names by their places only, so that they may have any name, its own helpers' too."""

    @wraps(stage)
    def run(documents: DataFrame, *args, **more) -> DataFrame:
        names = documents.columns
        plain = [n if n in ("doc_id", "text", "n_chars") else f"column_{i}" for i, n in enumerate(names)]
        return stage(documents.toDF(*plain), *args, **more).toDF(*names)

    return run


def row_names() -> tuple[Column, Column]:
    """(id, tie), which tell rows of documents apart by doc_id and text: doc_id and a 64-bit hash of the text; without doc_id two
    such hashes."""
    known = F.col("doc_id").cast("long")
    return F.coalesce(known, F.xxhash64(F.lit(1), "text")).alias("id"), F.xxhash64(known.isNull(), "text").alias("tie")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Every operator with Python code calls it.  Lets Python workers import this package from where it lies, whatever folder the driver was started in.  On a cluster without
    that folder, ship the package with --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
