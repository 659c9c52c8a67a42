"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

The logit is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs are scored in linear time by the sum-of-squares identity,
half of (sum v_i x_i) ** 2 - sum v_i ** 2 x_i ** 2 in each of the `rank` dimensions.

It is fitted on at most `train_docs` labelled documents with at most `train_features` features (documented bounds, in the order of a
hash of the id), whose features, not texts, reach the driver; every document is scored where it is read, without a shuffle.

Defined results: null or empty text has no words and gets the score of its statistics; rows are scored by their text alone, so repeated
rows get equal scores; with no labelled document, or one label only, every score is the share of label 1 (0.5 if there is none);
extra columns are ignored; a document labelled several times has the highest label; rows without doc_id are never trained on; texts of any
length are taken whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import U64, SpanHash, importable, materialize, sums_by_row, text_slices, word_spans
from llm.quality_rules import BUCKETS, measure

BITS = 15
STATISTICS = 16
FEATURES = (1 << BITS) + STATISTICS


@dataclass(frozen=True)
class Parameters:
    train_docs: int = 6000
    #: Features (distinct word buckets) of all training documents together, which bounds what reaches the driver.
    train_features: int = 12_000_000
    rank: int = 8
    epochs: int = 8
    #: Small samples are gone through more often, till so many examples were seen.
    least_seen: int = 48_000
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-5
    threshold: float = 0.3


def _class(*chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list("".join(chars).encode())] = True
    return table


DIGIT, UPPER, LINE, PUNCTUATION, TABLE = _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("\n"), _class(".,;:!?"), _class("|{}[]=_/\\@")
HIGH = np.arange(256) > 127
_NO_RATIO = np.zeros(BUCKETS)


def statistics(buf: np.ndarray, offsets: np.ndarray, words: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """One row of structure statistics for each text; words, distinct: numbers of words and of distinct word buckets."""
    m = measure(buf, offsets, _NO_RATIO)
    size = np.maximum(np.diff(offsets), 1)
    n = np.maximum(words, 1)
    share = [sums_by_row(t[buf], offsets) / size for t in (DIGIT, UPPER, LINE, PUNCTUATION, TABLE, HIGH)]
    lines = sums_by_row(LINE[buf], offsets) + 1
    own = [np.log1p(words), np.log1p(np.diff(offsets)), m["word_chars"] / n, m["n_symbols"] / n, m["n_symbols"] / size, m["n_dup_lines"] / lines, m["n_repeat_words"] / n, distinct / n, np.log1p(size / lines)]
    return np.column_stack([*own, *share, words < 10]).astype(np.float64)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where each row's words begin, with the end of the last; buckets; values of unit length; statistics)."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(buf, offsets)
    bucket = (SpanHash(buf)(starts, ends) >> U64(64 - BITS)).astype(np.int64)
    keys, counts = np.unique(rows << BITS | bucket, return_counts=True)
    row, value = keys >> BITS, np.log1p(counts)
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    cuts = np.searchsorted(row, np.arange(n + 1))
    return cuts, keys & ((1 << BITS) - 1), value / length[row], statistics(buf, offsets, np.bincount(rows, minlength=n), np.diff(cuts))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, cuts: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) with the statistics brought to a common scale."""
        n = len(cuts) - 1
        row = np.concatenate([np.repeat(np.arange(n), np.diff(cuts)), np.repeat(np.arange(n), STATISTICS)])
        feature = np.concatenate([bucket, np.tile(np.arange(1 << BITS, FEATURES), n)])
        scaled = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        order = np.argsort(row, kind="stable")
        return row[order], feature[order], np.concatenate([value, scaled.ravel()])[order]

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, sums of v_i x_i, v_i x_i); every row has features."""
        start = np.searchsorted(row, np.arange(n))
        vx = self.factors[feature] * value[:, None]
        sums, squares = np.add.reduceat(vx, start, axis=0), np.add.reduceat(vx**2, start, axis=0)
        return self.bias + np.add.reduceat(self.weight[feature] * value, start) + 0.5 * (sums**2 - squares).sum(1), sums, vx

    def score(self, *parts: np.ndarray) -> np.ndarray:
        n = len(parts[0]) - 1
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.rows(*parts), n)[0], -40, 40))) if n else np.zeros(0)


def fit_machine(cuts: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, p: Parameters) -> Machine:
    """Adaptive gradient descent on the log loss; every number of it is fixed, so equal samples give equal machines."""
    share = float(label.mean()) if len(label) else 0.5
    random = np.random.default_rng(7)
    clipped = min(max(share, 1e-9), 1 - 1e-9)
    m = Machine(float(np.log(clipped / (1 - clipped))), np.zeros(FEATURES), np.zeros((FEATURES, p.rank)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if share in (0.0, 1.0) or not len(label):
        return m
    m.factors = random.normal(0, 0.02, (FEATURES, p.rank))
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-4), np.full((FEATURES, p.rank), 1e-4), 1e-4
    for _ in range(max(p.epochs, -(-p.least_seen // len(label)))):
        order = random.permutation(len(label))
        for at in range(0, len(order), p.batch):
            own = order[at : at + p.batch]
            size = np.diff(cuts)[own]
            take = np.repeat(cuts[:-1][own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            row, feature, x = m.rows(np.concatenate([[0], np.cumsum(size)]), bucket[take], value[take], stats[own])
            logit, sums, vx = m.logits(row, feature, x, len(own))
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label[own]) / len(own)
            used, of = np.unique(feature, return_inverse=True)
            step = error[row] * x
            grad_w = np.bincount(of, weights=step, minlength=len(used)) + p.decay * m.weight[used]
            each = step[:, None] * (sums[row] - vx)
            by = np.argsort(of, kind="stable")
            grad_v = np.add.reduceat(each[by], np.searchsorted(of[by], np.arange(len(used))), axis=0) + p.decay * m.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += error.sum() ** 2
            m.weight[used] -= p.rate * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= p.rate * grad_v / np.sqrt(seen_v[used])
            m.bias -= p.rate * error.sum() / np.sqrt(seen_b)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Machine:
    importable(documents.sparkSession)
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                cuts, bucket, value, stats = features(buf, offsets)
                parts = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in ("doc_id", "quality")), *parts, pa.array([x.tobytes() for x in stats], pa.binary())], names=["doc_id", "quality", "bucket", "value", "stats"])

    # the sample is bounded by train_docs, and so is what is broadcast
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    described = materialize(sample.mapInArrow(describe, "doc_id long, quality int, bucket binary, value binary, stats binary"), "described")
    sizes = described.groupBy("doc_id").agg((F.sum(F.octet_length("bucket")) / 4).alias("n"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most train_docs rows
    kept = sizes.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= p.train_features).select("doc_id")
    rows = described.join(F.broadcast(kept), "doc_id", "left_semi").toArrow().sort_by([("doc_id", "ascending"), ("bucket", "ascending")])
    bucket = [np.frombuffer(x, np.int32) for x in rows.column("bucket").to_pylist()]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in bucket])]).astype(np.int64)
    flat = np.concatenate(bucket).astype(np.int64) if bucket else np.zeros(0, np.int64)
    value = np.frombuffer(b"".join(rows.column("value").to_pylist()), np.float32).astype(np.float64)
    stats = np.frombuffer(b"".join(rows.column("stats").to_pylist()), np.float64).reshape(-1, STATISTICS)
    return fit_machine(cuts, flat, value, stats, (np.array(rows.column("quality").to_pylist()) > 0).astype(float), p)


def score_documents(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    machine = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text", 1 << 20):
                score = machine.value.score(*features(buf, offsets))
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
