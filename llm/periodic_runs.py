"""Periodic runs of words: maximal stretches that repeat with a smallest period, at least `min_exponent` times over, found by multi-scale
minimizers.

Scale L finds the periods from L / 2 + 1 to L.  Of every window of L / 2 places the one with the least hash of its next few words is a
minimizer.  Inside a run these hashes repeat at the distance of the period, and so do the windows' minima; a run of four periods is long
enough that one window and the same a period later lie in it, both with L words after their minima.  These L words are the key of a
minimizer.  Two places of a run less than a smallest period apart cannot have L equal words, so neighbours in the order (key, place) are
exactly one period apart: a seed.  Seeds of one distance that overlap are joined, then extended to both sides as long as words are
equal.  Minima of all scales come from one array by doubling the window; there are about 4 n / L keys at scale L, so all scales
together compare few words.  Periods up to `short` are found by scans, one for each lag.

Words are numbered by their bytes, so equality is exact; hashes only choose places.  Many short texts are handled as one array, parted by
numbers of their own that nothing equals.  A document is one row of a map without shuffle: a lost task is done again from its input.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; every run is returned, nested and overlapping
ones too; repeated rows are answered each; memory is that of the longest text in a task, about 40 bytes for each of its words; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import U64, WordHash, importable, mix, text_slices


@dataclass(frozen=True)
class Parameters:
    min_length: int = 6
    #: The scales need four periods at least.
    min_exponent: int = 4
    #: A power of two; longer periods are found by minimizers.
    short: int = 16


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True that are `least` long or longer."""
    at = np.flatnonzero(equal)
    if len(at) < least:
        return at[:0], at[:0]
    breaks = np.flatnonzero(np.diff(at) != 1)
    starts, ends = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def extend(x: np.ndarray, begin: int, end: int, lag: int) -> tuple[int, int]:
    """The widest range around begin .. end in which x[t] == x[t + lag]; steps double, so that the work is that of the range."""
    step = 64
    while begin > 0:
        step = min(step, begin)
        differ = np.flatnonzero(x[begin - step : begin] != x[begin - step + lag : begin + lag])
        if len(differ):
            begin += int(differ[-1]) + 1 - step
            break
        begin, step = begin - step, 2 * step
    step, most = 64, len(x) - lag
    while end < most:
        step = min(step, most - end)
        differ = np.flatnonzero(x[end : end + step] != x[end + lag : end + lag + step])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + step, 2 * step
    return begin, end


def smallest(x: np.ndarray, start: int, period: int) -> bool:
    """Whether no divisor of a period is one; any smaller period of so long a run divides it."""
    left, f = period, 2
    while left > 1:
        if f * f > left:
            f = left
        if left % f == 0:
            g = period // f
            if np.array_equal(x[start : start + period], x[start + g : start + g + period]):
                return False
            while left % f == 0:
                left //= f
        f += 1
    return True


def seeds(x: np.ndarray, longest: int, p: Parameters) -> Iterator[tuple[int, int, int]]:
    """(begin, end, lag): x[t] == x[t + lag] for begin <= t < end, by equal hashes; every run with a period over `short` has one."""
    n, scale = len(x), 2 * p.short
    if scale // 2 + 1 > longest // p.min_exponent:
        return
    words = mix(x.astype(np.int64).view(U64))
    content = WordHash(words)
    gram = words.copy()  # of up to four words
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 1):
        gram[:-k] += words[k:] * U64(odd)
    least = (mix(gram) >> U64(32) << U64(32)) | np.arange(n, dtype=U64)  # the leftmost of equal hashes
    del gram, words
    width = 1
    while scale // 2 + 1 <= longest // p.min_exponent:
        while width < scale // 2 and len(least) > width:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        place = (least & U64(0xFFFFFFFF)).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        place = place[place + scale <= n]
        key = content(place, place + scale)
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        lag = place[1:] - place[:-1]
        pair = np.flatnonzero((key[1:] == key[:-1]) & (lag > scale // 2) & (lag <= scale))
        at, lag = place[pair], lag[pair]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        if len(at):
            new = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + scale)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            yield from zip(at[first].tolist(), (at[last] + scale).tolist(), lag[first].tolist())
        scale *= 2


def runs(x: np.ndarray, longest: int, p: Parameters) -> np.ndarray:
    """Rows of start, length, period, by start and period: all runs of a sequence of numbers, none of which is in runs longer than `longest`."""
    found: set[tuple[int, int, int]] = set()
    for q in range(1, min(p.short, longest // p.min_exponent) + 1):
        least = max(p.min_length, p.min_exponent * q) - q
        for s, e in zip(*stretches(x[q:] == x[:-q], least)):
            found.add((int(s), int(e - s) + q, q))
    done: dict[int, int] = {}  # how far stretches of a lag are known
    for begin, end, lag in seeds(x, longest, p):
        parts = [(begin, end)]
        if not np.array_equal(x[begin:end], x[begin + lag : end + lag]):  # hashes clashed
            parts = [(begin + int(s), begin + int(e)) for s, e in zip(*stretches(x[begin:end] == x[begin + lag : end + lag], 1))]
        for b, e in parts:
            if e > done.get(lag, -1):
                b, e = extend(x, b, e, lag)
                done[lag] = e
                if e - b + lag >= max(p.min_length, p.min_exponent * lag):
                    found.add((b, e - b + lag, lag))
    kept = sorted((r for r in found if smallest(x, r[0], r[2])), key=lambda r: (r[0], r[2]))
    return np.array(kept, np.int64).reshape(-1, 3)


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


def _answer(own: pa.RecordBatch, texts: list[list[bytes]], p: Parameters) -> pa.RecordBatch:
    """The rows of SCHEMA for a few texts, split into words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes  # a number that nothing equals stands before each text
    x = np.empty(int(sizes.sum()) + len(texts), np.int32)
    inside = np.ones(len(x), bool)
    inside[begin - 1] = False
    x[begin - 1] = -1 - np.arange(len(texts))
    x[inside] = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
    found = runs(x, int(sizes.max()), p)
    row = np.searchsorted(begin, found[:, 0], "right") - 1
    found[:, 0] -= begin[row]
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    collapsed = []
    for t, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            change = np.zeros(len(t) + 1, np.int64)
            np.add.at(change, found[a:b, 0] + found[a:b, 2], 1)
            np.add.at(change, found[a:b, 0] + found[a:b, 1], -1)
            t = [t[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(t).decode())
    each = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)
    return pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(sizes), listed, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, n_words, runs (start as a word's number, length and smallest period, by start and period), collapsed: the words outside of
    runs and those of each run's first period, joined by one space.  A word goes if any run has it after its first period."""
    if p.min_exponent < 4 or p.short & (p.short - 1):
        raise ValueError("runs have four periods or more, and `short` is a power of two")
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                data, cuts = buf.tobytes(), offsets.tolist()
                yield _answer(batch.slice(first, last - first), [data[a:b].split() for a, b in zip(cuts, cuts[1:])], p)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def strongest(runs: str) -> Column:
    """The run with the greatest length by period, compared exactly; the first of equal ones.  Null without runs."""
    none = F.get(F.col(runs), F.lit(0))
    more = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    return F.aggregate(runs, none, lambda a, r: F.when(more(a, r), r).otherwise(a))
