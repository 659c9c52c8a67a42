"""Histograms whose bins double when the range grows: one pass, any order, mergeable.

Bins lie on a grid of powers of two: bin k at level e holds k * 2 ** e <= x < (k + 1) * 2 ** e.  Two neighbours are one bin a level up, so a
histogram is coarsened without looking at its values again, and the level that a range needs does not depend on how the rows were dealt:
partial histograms of tasks, files or runs give the same as one over all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.session import importable

#: Bins are not finer than 2 ** FINEST, and their numbers stay below LARGEST, so that doubles hold them.
FINEST, LARGEST = -40, 1 << 52
PARTIAL = "group long, level int, bin long, k long"


class Doubling:
    """Counts of one group in at most `bins` bins."""

    def __init__(self, bins: int):
        self.bins, self.level, self.low, self.counts = bins, FINEST, 0, np.zeros(0, np.int64)

    def fit(self, low: float, high: float) -> None:
        """Makes room for low .. high beside what is held."""
        level = self.level
        while True:
            a, b = int(np.floor(np.ldexp(low, -level))), int(np.floor(np.ldexp(high, -level)))
            if len(self.counts):
                a, b = min(a, self.low >> level - self.level), max(b, self.low + len(self.counts) - 1 >> level - self.level)
            if b - a < self.bins and max(-a, b) < LARGEST:
                break
            level += 1
        counts = np.zeros(b - a + 1, np.int64)
        np.add.at(counts, (np.arange(self.low, self.low + len(self.counts)) >> level - self.level) - a, self.counts)
        self.level, self.low, self.counts = level, a, counts

    def add(self, x: np.ndarray) -> None:
        self.fit(float(x.min()), float(x.max()))
        at = np.floor(np.ldexp(x, -self.level)).astype(np.int64) - self.low
        self.counts += np.bincount(at, minlength=len(self.counts))


def partial_histograms(vectors: DataFrame, column: str, bins: int) -> DataFrame:
    """PARTIAL: histograms of each task's values by their place in a vector (group).  Nulls and what is not finite are left out.  A task
    holds `bins` counts for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Doubling] = {}
        for batch in batches:
            lists = batch.column(0).drop_null()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False)
            place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.isfinite(x)
            x, place = x[keep], place[keep]
            order = np.argsort(place, kind="stable")
            x, place = x[order], place[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                held.setdefault(int(place[a]), Doubling(bins)).add(x[a:b])
        for group, h in held.items():
            at = np.flatnonzero(h.counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group)), pa.array(np.full(len(at), h.level, np.int32)), pa.array(at + h.low), pa.array(h.counts[at])], names=["group", "level", "bin", "k"])

    importable(vectors.sparkSession)
    return vectors.select(F.transform(column, lambda x: x.cast("double")).alias("x")).mapInArrow(run, PARTIAL)


def merged_histograms(partials: DataFrame, bins: int) -> DataFrame:
    """group, level, bin, k: partials of any number of tasks and runs as one histogram for each group, at the finest level at which all of
    it fits `bins` bins."""
    coarse = lambda bin_, by: F.floor(bin_ / F.pow(F.lit(2.0), by)).cast("long")
    top = partials.groupBy("group").agg(F.max("level").alias("top"))
    held = partials.join(top, "group").select("group", "top", coarse(F.col("bin"), F.col("top") - F.col("level")).alias("bin"), "k")
    held = held.groupBy("group", "top", "bin").agg(F.sum("k").alias("k"))
    ends = held.groupBy("group").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    # the number of bins halves with each level: at most one more than the logarithm is needed
    more = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(80)), lambda u: coarse(F.col("b"), u) - coarse(F.col("a"), u) < bins))
    grown = held.join(ends.select("group", more.alias("more")), "group")
    return grown.groupBy("group", (F.col("top") + F.col("more")).alias("level"), coarse(F.col("bin"), F.col("more")).alias("bin")).agg(F.sum("k").alias("k"))


def quantiles(histograms: DataFrame, shares: list[float]) -> DataFrame:
    """group, width and a value for each share, q01 for 0.01: the lower edge of the bin that has the value of rank ceil(share * n), which
    is thus less than a bin's width below it."""
    order = Window.partitionBy("group").orderBy("bin")  # at most `bins` rows
    upto = histograms.withColumns({"upto": F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy("group"))})
    width = F.pow(F.lit(2.0), F.col("level"))
    found = [(F.min(F.when(F.col("upto") >= F.col("n") * s, F.col("bin"))) * F.first(width)).alias(f"q{round(100 * s):02d}") for s in shares]
    return upto.groupBy("group").agg(F.first(width).alias("width"), *found)
