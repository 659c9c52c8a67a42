"""Quality rules: a document is judged by the log-likelihood ratio of its hashed n-grams under two multinomials, one of trusted
text and one of the raw corpus, divided by the number of n-grams, against a fixed threshold.

Word unigrams and bigrams are hashed to `BUCKETS` buckets.  The raw multinomial counts every document, the trusted one every document
that a table of labels marks 1 (a join).  What reaches the driver is one row per bucket, whatever the size of the corpus.

Defined results: null or empty text has no words, fails the base rules and gets score 0; texts of any length are judged whole.  A row
is judged by its text alone, so repeated rows get equal verdicts (and count once each); a row without doc_id is never trusted; a
document labelled several times is trusted if one label is 1.  Extra columns are kept by `keep_good` and dropped by
`score_documents`.  Without any trusted document the two multinomials coincide: every score is 0 and only the base rules reject.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import SPACE, U64, SpanHash, importable, lean, line_spans, mix, plain_names, sums_by_row, text_slices, word_spans

BUCKETS = 1 << 16
_MULTIPLIERS = mix(np.arange(1, 6, dtype=U64)) | U64(1)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Parameters:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Mean log ratio, in nats, below which a document is rejected.
    min_score: float = -0.15
    #: N-grams of raw text that the trusted counts are mixed with: little trusted text says little, and rejects nothing.
    prior: float = 200_000.0


def _ngrams(word_hash: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every unigram and of every bigram within a row."""
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    bigram = mix(word_hash[pair] * _MULTIPLIERS[0] + word_hash[pair + 1] * _MULTIPLIERS[1])
    return (np.concatenate([word_hash, bigram]) >> U64(48)).astype(np.int64), np.concatenate([rows, rows[pair]])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(buf: np.ndarray, offsets: np.ndarray, log_ratio: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the score of each row."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(buf, offsets)
    spans = SpanHash(buf)
    words = spans(starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n)}
    out["word_chars"] = sums_by_row(~((buf & 0xC0) == 0x80) & ~SPACE[buf], offsets)
    out["n_symbols"] = sums_by_row(SYMBOL[buf], offsets)
    line_start, line_end, line_row = line_spans(buf, offsets)
    worded = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~SPACE[buf], out=worded[1:])
    has = worded[line_end] > worded[line_start]
    line_row = line_row[has]
    key = mix(spans(line_start[has], line_end[has]) + mix(line_row))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(rows) >= 5:
        at = np.flatnonzero(rows[4:] == rows[:-4])
        key = mix(rows[at])
        for i in range(5):
            key = key + words[at + i] * _MULTIPLIERS[i]
        hit = at[_repeats(mix(key))]
        cover = np.zeros(len(rows) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        out["n_repeat_words"] = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    bucket, row = _ngrams(words, rows)
    total = np.bincount(row, weights=log_ratio[bucket], minlength=n)
    out["score"] = total / np.maximum(np.bincount(row, minlength=n), 1)
    return out


def count_ngrams(texts: DataFrame) -> DataFrame:
    """bucket, n: how often the n-grams of each bucket occur in a column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch, "text"):
                starts, ends, rows = word_spans(buf, offsets)
                counts += np.bincount(_ngrams(SpanHash(buf)(starts, ends), rows)[0], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    return texts.mapInArrow(lean(count), "bucket int, n long")


def fit(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> np.ndarray:
    """log(trusted share / raw share) of each bucket."""
    importable(documents.sparkSession)
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    # a merge join at every size: labels grow with the documents, and so are not broadcast
    target = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(trusted.hint("merge"), "doc_id", "left_semi").select("text")
    both = count_ngrams(documents.select("text")).withColumn("trusted", F.lit(0)).unionByName(count_ngrams(target).withColumn("trusted", F.lit(1)))
    found = both.groupBy("bucket").agg(F.sum(F.col("n") * (1 - F.col("trusted"))).alias("raw"), F.sum(F.col("n") * F.col("trusted")).alias("target"))
    counts = np.zeros((2, BUCKETS))
    for r in found.collect():
        counts[0, r.bucket], counts[1, r.bucket] = r.raw, r.target
    raw, target = counts
    if not target.sum():
        return np.zeros(BUCKETS)
    share = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + p.prior * share) / (target.sum() + p.prior)) - np.log(share)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score_documents(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept: one row per document, without a shuffle."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, p))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                m = measure(buf, offsets, model.value)
                failed = (m["n_words"] < p.min_words) | (100 * m["n_repeat_words"] > p.max_repeat_percent * m["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), *(pa.array(m[c].astype(np.int64)) for c in COLUMNS), pa.array(failed), pa.array(m["score"]), pa.array(~failed & (m["score"] >= p.min_score))],
                    names=["doc_id", *COLUMNS, "base_failed", "score", "kept"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(judge), "doc_id long, " + "".join(f"{c} long, " for c in COLUMNS) + "base_failed boolean, score double, kept boolean")


@plain_names
def keep_good(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model, schema = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, p)), documents.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for first, last, buf, offsets in text_slices(batch, "text"):
                m = measure(buf, offsets, model.value)
                good[first:last] = (m["n_words"] >= p.min_words) & (100 * m["n_repeat_words"] <= p.max_repeat_percent * m["n_words"]) & (m["score"] >= p.min_score)
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(lean(keep), schema)
