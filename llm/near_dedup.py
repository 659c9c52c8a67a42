"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash fingerprints in pivot distance tables list candidates, the
shingle sets decide.

Texts of equal shingle sets are combined first; each set has a SimHash fingerprint.  What enters one table is decided by keys, as in
simhash_dedup; but fingerprints of sets of similarity 0.8 differ in about 10 bits of 64, more than blocks of bits can cover, so the keys
are `bands` ones of `rows` minhashes: two sets of similarity s share a key with probability 1 - (1 - s ** rows) ** bands, all but 7 in
a million at 0.8, fewer above.  Within a table, distances to reference fingerprints list the pairs within `reach` bits and discard
them, the fingerprints verify the rest; each member goes on with the nearest before it and with the first of its key, which stands in
all tables of a large key.  What of these is similar by the shingle sets is one component.

No radius over fingerprints is sure to cover a similarity, so it bounds only what is listed first.  Keys that then still hold several
components are compared block by block: their sets are cut into blocks of a bounded size, each two blocks meet in one task, which counts
the shingles that sets have in common and returns only the pairs that are similar.  So no pair that shares a key is left out unless it is
linked already, pairs that are not similar never become rows, and a large key is many tasks.

Defined results: words are of lower-cased (A-Z) text; a text of fewer words than `width` is one shingle; null texts and those without
words have no shingle, and one of them stays.  Rows without an id stand under a hash of their text; of rows with one id and text one stays; of
a component the row of the smallest id, then of the least hash of its text.  A very long text is one set, whole, in the memory of a task
that meets it.  Extra columns of any name are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import U64, SpanHash, discard, importable, lean, materialize, mix, plain_names, text_slices, word_spans
from llm.graph import components
from llm.simhash_dedup import UPPER, majority, pivot_pairs


@dataclass(frozen=True)
class Parameters:
    width: int = 5
    similarity: float = 0.8
    rows: int = 5
    bands: int = 30
    #: Bits in which the fingerprints of a pair that a table lists differ, at most.
    reach: int = 16
    #: Blocks of a key hold about so many shingles, and sets, at most; so do its tables, of sets.
    block_shingles: int = 200_000
    block_sets: int = 1000


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of each row's distinct shingles, sorted by row and hash."""
    n = len(offsets) - 1
    buf = UPPER[buf]
    starts, ends, rows = word_spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    words = SpanHash(buf)(starts, ends)
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    size = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    begin = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    row = np.repeat(np.arange(n), size)
    left = np.minimum((first + counts)[row] - begin, width)
    factors = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    hashes = mix(left)
    for i in range(width):
        some = np.flatnonzero(left > i)
        hashes[some] += words[begin[some] + i] * factors[i]
    hashes = mix(hashes)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def sketch(rows: DataFrame, p: Parameters) -> DataFrame:
    """__id, __text, sig (a name of the shingle set), n (its size), fp (its fingerprint), keys."""
    seeds = (mix(np.arange(1, p.rows * p.bands + 1, dtype=U64) + U64(1 << 40)) | U64(1)).reshape(p.bands, p.rows)
    factors = mix(np.arange(1, p.rows + 1, dtype=U64) + U64(1 << 41)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                hashes, row = shingles(buf, offsets, p.width)
                count = np.bincount(row, minlength=last - first)
                some = np.flatnonzero(count)
                edges = (np.cumsum(count) - count)[some]
                sig, keys = np.zeros(last - first, U64), np.zeros((len(some), p.bands), U64)
                if len(some):
                    sig[some] = mix(np.add.reduceat(mix(hashes), edges) + mix(count[some]))
                    for band, own in enumerate(seeds):
                        keys[:, band] = mix(sum(np.minimum.reduceat(hashes * s, edges) * f for s, f in zip(own, factors)) + U64(band))
                cuts = np.concatenate([[0], np.cumsum((count > 0) * p.bands)]).astype(np.int32)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column("__id"), own.column("__text"), pa.array(sig.view(np.int64)), pa.array(count.astype(np.int64)), pa.array(majority(hashes, count).view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel().view(np.int64)))], names=["__id", "__text", "sig", "n", "fp", "keys"])

    return rows.mapInArrow(lean(run), "__id long, __text long, sig long, n long, fp long, keys array<long>")


def near_in_tables(table: np.ndarray, sig: np.ndarray, n: np.ndarray, fps: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), sigs: of each member of a table the nearest one before it, and the table's first, where within reach and of fitting size.
    Rows are sorted by table and sig."""
    first = np.searchsorted(table, table)
    far = np.int64(1) << 62
    nearest, star = np.full(len(table), far), np.zeros(len(table), bool)
    for a, b in pivot_pairs(table, fps, p.reach):
        a, b = np.minimum(a, b), np.maximum(a, b)
        fit = np.minimum(n[a], n[b]) >= p.similarity * np.maximum(n[a], n[b])
        a, b = a[fit], b[fit]
        np.minimum.at(nearest, b, np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64) << 40 | a)
        star[b[a == first[b]]] = True
    near, star = np.flatnonzero(nearest < far), np.flatnonzero(star)
    return sig[np.concatenate([nearest[near] & (1 << 40) - 1, first[star]])], sig[np.concatenate([near, star])]


def listed(held: DataFrame, p: Parameters) -> DataFrame:
    """a, b, a before b: the pairs that the tables list.  held: key, sig, n, fp, a (the key's first sig), tables (how many it has)."""
    table = F.when(F.col("sig") == F.col("a"), F.expr("sequence(0L, tables - 1)")).otherwise(F.array(F.pmod(F.xxhash64("sig"), F.col("tables"))))
    rows = held.select("key", F.explode(table).alias("table"), "sig", "n", "fp").repartition("key", "table").sortWithinPartitions("key", "table", "sig")

    def pairs(columns: list[np.ndarray], new: np.ndarray) -> pa.RecordBatch:
        _, _, sig, n, fp = columns
        a, b = near_in_tables(np.cumsum(new), sig, n, fp.view(U64), p)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            left = [np.concatenate(x) for x in zip(left, (c.to_numpy(zero_copy_only=False) for c in batch.columns))]
            new = np.zeros(len(left[0]), bool)
            new[1:] = (left[0][1:] != left[0][:-1]) | (left[1][1:] != left[1][:-1])
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0  # the last table may go on in the next batch
            if cut:
                yield pairs([x[:cut] for x in left], new[:cut])
            left = [x[cut:] for x in left]
        if len(left[0]):
            yield pairs(left, np.zeros(len(left[0]), bool))

    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def _sets(named: DataFrame, rows: DataFrame, wanted: DataFrame, p: Parameters) -> DataFrame:
    """sig, hashes: the shingle sets of the wanted sigs."""
    of = rows.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("__id", "__text")).alias("c")).select("sig", F.col("c.__id").alias("__id"), F.col("c.__text").alias("__text"))
    texts = named.select("__id", "__text", "text").join(of, ["__id", "__text"]).select("sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                hashes, row = shingles(buf, offsets, p.width)
                cuts = np.searchsorted(row, np.arange(last - first + 1)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("sig").slice(first, last - first), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["sig", "hashes"])

    return texts.mapInArrow(lean(run), "sig long, hashes binary").dropDuplicates(["sig"])


def _similar(pairs: DataFrame, sets: DataFrame, p: Parameters) -> DataFrame:
    """The pairs a, b whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(both >= p.similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return full.mapInArrow(lean(run), "a long, b long")


def _across(members: DataFrame, sets: DataFrame, p: Parameters) -> DataFrame:
    """The pairs a, b of a key that lie in different components and have the similarity.  members: key, sig, n, root, blocks."""
    dealt_ = members.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = dealt_.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sig", "root").join(sets, "sig")

    def run(_: tuple, table: pa.Table) -> pa.Table:
        sig, root, own = (table.column(c).to_numpy() for c in ("sig", "root", "own"))
        parts = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        n = np.array([len(x) for x in parts])
        token, row = np.concatenate(parts), np.repeat(np.arange(len(n)), n)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        start = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
        size = np.diff(np.append(start, len(token)))
        both = np.zeros((len(n), len(n)), np.int32)
        for s, f in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            at = row[s : s + f]
            both[at[:, None], at] += 1
        close = (both >= p.similarity * (n[:, None] + n - both)) & (root[:, None] != root)
        if own.min() != own.max():
            close &= own[:, None] != own  # pairs within a block are its own task's
        i, j = np.nonzero(np.triu(close, 1))
        return pa.table([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])], names=["a", "b"])

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def links(named: DataFrame, rows: DataFrame, p: Parameters) -> DataFrame:
    """node, root: of the components of more than one shingle set."""
    held = materialize(rows.select(F.explode("keys").alias("key"), "sig", "n", "fp").distinct(), "bands")
    shared = held.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("last"), F.ceil(F.count("*") / p.block_sets).alias("tables")).where("last > a").select("key", "a", "tables")
    shared, bands = materialize(shared, "shared"), held
    held = materialize(held.join(shared, "key").select("key", "sig", "n", "fp", "a", "tables"), "held")
    discard(bands)
    discard(shared)
    tested = materialize(listed(held, p), "listed")
    sets = materialize(_sets(named, rows, held.select("sig").distinct(), p), "sets")
    found = materialize(_similar(tested, sets, p), "found")
    roots = materialize(components(found).toDF("sig", "root"), "roots")
    members = held.join(roots, "sig", "left").select("key", "sig", "n", F.coalesce("root", "sig").alias("root"))
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("all"), F.count("*").alias("sets")).where("low < high")
    several = materialize(several.select("key", F.ceil(F.greatest(F.col("all") / p.block_shingles, F.col("sets") / p.block_sets)).alias("blocks")), "several")
    again = materialize(_across(members.join(several, "key"), sets, p), "again")
    out = components(found.unionByName(again))
    for done in (held, tested, sets, found, roots, several, again):
        discard(done)
    return out


@plain_names
def keep_one(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One document of each component, that of the smallest id, with all columns."""
    importable(documents.sparkSession)
    named = documents.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "__text": F.xxhash64("text")})
    rows = materialize(sketch(named.select("__id", "__text", "text"), p), "sketches")
    roots = materialize(links(named, rows, p), "groups")
    first = rows.select("__id", "__text", "sig").join(roots, F.col("sig") == F.col("node"), "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min(F.struct("__id", "__text")).alias("c"))
    chosen = first.select(F.col("c.__id").alias("__id"), F.col("c.__text").alias("__text"))
    return named.join(chosen, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select(*documents.columns)
