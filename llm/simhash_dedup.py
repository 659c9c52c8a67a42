"""Near-duplicates by 64-bit SimHash fingerprints, linked through pivot distance tables.

Equal fingerprints are combined first.  Pivot coordinates alone would put about half of all pairs within the radius of each other in
each coordinate, so what enters one table is decided by block keys: the bits are cut into m blocks, and fingerprints within `radius`
bits agree on at least m - radius of them, so each goes to the table of every choice of m - radius blocks; m follows from how many
there are.  Within a table, Hamming distances to reference fingerprints are computed once for each member; members are sorted by the
distance to the first reference, and each is paired with those that follow within the radius in that coordinate; pairs further apart in
any other coordinate are discarded, and the survivors verified.  The members of a large table are first dealt to finer ones by the
bits in which they differ.  What is a large table then holds members near each other, and takes these as pivots: what lies within the
radius of a pivot is linked to it, and by the triangle inequality only what lies within twice the radius can have links into that ball.
A partition returns a forest of its links, not the pairs; components over all partitions follow on DataFrames.

Defined results: null, empty or blank text has fingerprint zero, linked like any other; equal texts and repeated rows share fingerprint
and component; a component of rows without doc_id has a null id; texts of any length are taken whole; extra columns are ignored by
`near_groups` and kept by `keep_one`; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import U64, gather, importable, materialize, mix, partitions, plain_names, text_slices, word_spans
from llm.graph import components

#: Reference fingerprints of the pivot tables.
PIVOTS = mix(np.arange(1, 25, dtype=U64) * U64(0xA24BAED4963EE407))
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each row, whose hashes follow one another: a bit is 1 if it is set in over half of them; zero without any."""
    out, some = np.zeros(len(sizes), U64), np.flatnonzero(sizes)
    if not len(some):
        return out
    edges = (np.cumsum(sizes) - sizes)[some]
    votes = np.zeros((len(some), 64), np.int64)
    ones = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i in range(8):
        votes[:, 8 * i : 8 * i + 8] = np.add.reduceat(np.unpackbits(ones[:, i : i + 1], axis=1, bitorder="little"), edges, axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > sizes[some][:, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(bits).view("<u8").ravel()
    return out


def fingerprints(buf: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """Of each row: a bit is 1 if it is set in over half the hashes of the row's shingles."""
    n = len(offsets) - 1
    buf = UPPER[buf]
    starts, ends, rows = word_spans(buf, offsets)
    if not len(starts):
        return np.zeros(n, U64)
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)  # words again, one space after each
    flat = np.full(int((size + 1).sum()), 0x20, np.uint8)
    flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = gather(buf, starts, size)
    counts = np.bincount(rows, minlength=n)
    first_word = np.cumsum(counts) - counts
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    begin = np.repeat(first_word - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    row = np.repeat(np.arange(n), shingles)
    end = np.minimum(begin + width, (first_word + counts)[row]) - 1
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(at[begin].tolist(), (at[end] + size[end]).tolist())), U64, len(begin))
    return majority(hashes, shingles)


def fingerprint(documents: DataFrame, width: int = 4, *keep: str) -> DataFrame:
    """doc_id and what else is kept, fp long."""
    importable(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    schema = rows.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                fp = fingerprints(buf, offsets, width).view(np.int64)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in schema[:-1]), pa.array(fp)], names=schema.names)

    return rows.mapInArrow(run, schema)


def block_masks(radius: int, n: int) -> list[int]:
    """Masks of block choices, fine enough that n spread-out fingerprints meet about once in a table key."""
    m = radius + 1
    while m < radius + 5 and n > 1 << (64 * (m - radius) // m):
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m - radius)]


def ball_links(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all distinct fps within the radius of each other, a few for each member: pivots are members."""
    while len(fps) > 1:
        distance = np.bitwise_count(fps ^ fps[0])
        ball, rest = fps[distance <= radius], distance > radius
        yield np.full(len(ball) - 1, fps[0]), ball[1:]
        near, at = fps[rest & (distance <= 2 * radius)], distance[distance <= radius]
        shell = distance[rest & (distance <= 2 * radius)]
        if len(ball) > 1:
            for i in range(0, len(near), max(1, 4_000_000 // len(ball))):
                own = slice(i, i + max(1, 4_000_000 // len(ball)))
                fit = (np.bitwise_count(near[own, None] ^ ball) <= radius) & (shell[own, None] - at <= radius)
                hit = np.flatnonzero(fit.any(1))
                yield near[own][hit], ball[fit[hit].argmax(1)]
        fps = fps[rest]


def window_pairs(place: np.ndarray, radius: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the sorted places that differ by the radius at most, each pair once, about `most` at a time."""
    at = np.arange(len(place))
    follow = np.searchsorted(place, place + radius, "right") - at - 1
    cuts = np.searchsorted(np.cumsum(follow), np.arange(0, int(follow.sum()), most), "right")
    for first, last in zip(cuts, [*cuts[1:], len(at)]):
        n = follow[first:last]
        a = np.repeat(at[first:last], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)


def pivot_pairs(table: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), the places of all pairs within the radius in one table: pivot coordinates list and discard them, the bits decide."""
    coordinates = np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS]).astype(np.int8)
    place = table * 256 + coordinates[0]  # tables lie further apart than any radius
    order = np.argsort(place)
    place, coordinates = place[order], coordinates[:, order]
    for a, b in window_pairs(place, radius):
        for other in coordinates[1:]:  # discarded by one coordinate after another
            close = np.abs(other[a] - other[b]) <= radius
            a, b = a[close], b[close]
        a, b = order[a], order[b]
        true = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        yield a[true], b[true]


def finer(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fps) of finer tables for the members of one: the bits in which any of them differ are cut into blocks, two more than the
    radius, and two members within it agree on two of these at least."""
    bits = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(fps ^ fps[0]).reshape(1).view(np.uint8), bitorder="little"))
    m = min(len(bits), radius + 2)
    blocks = [int(sum(1 << int(b) for b in bits[len(bits) * i // m : len(bits) * (i + 1) // m])) for i in range(m)]
    masks = [sum(c) for c in combinations(blocks, m - radius)] if m > radius else [0]
    keys = np.concatenate([mix((fps & U64(mask)) + mix(i)) for i, mask in enumerate(masks)])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.tile(fps, len(masks))[order]


def table_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 256, again: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within tables (runs of equal sorted keys).  The members of a large table are dealt to finer ones once; what is large then is
    a cloud of near members, and those are linked through members as pivots."""
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    size = np.diff(np.append(start, len(keys)))
    table, sizes = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
    own = np.flatnonzero((sizes > 1) & (sizes <= small))
    if len(own):
        members = fps[own]
        for a, b in pivot_pairs(table[own], members, radius):
            yield members[a], members[b]
    for s, g in zip(start[size > small], size[size > small]):
        if again:
            yield from table_links(*finer(fps[s : s + g], radius), radius, small, again=False)
        else:
            yield from ball_links(fps[s : s + g], radius)


def forest(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """node: root, for the nodes of all links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def link(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """distinct: fp (long), each once.  node, root: of the components of more than one fingerprint."""
    n, masks = partitions(distinct.sparkSession), block_masks(radius, distinct.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys and fingerprints, packed for each bucket."""
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(U64)
            keys = np.concatenate([mix((fps & U64(m)) + mix(i)) for i, m in enumerate(masks)])
            order = np.argsort(keys)
            keys, own = keys[order], np.tile(fps, len(masks))[order]
            bucket = ((keys >> U64(40)) * U64(n) >> U64(24)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (keys, own)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *blobs], names=["bucket", "keys", "fps"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b"".join(batch.column(c).to_pylist()) for c in ("keys", "fps")] for batch in batches]
        keys, fps = (np.frombuffer(b"".join(p[i] for p in parts), U64) for i in range(2))
        order = np.lexsort((fps, keys))
        found = forest((a.view(np.int64), b.view(np.int64)) for a, b in table_links(keys[order], fps[order], radius))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["a", "b"])

    dealt = distinct.mapInArrow(deal, "bucket int, keys binary, fps binary").repartitionById(n, "bucket")
    return components(dealt.mapInArrow(connect, "a long, b long"))


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """rows: doc_id, fp, materialised.  fp, root and component_id for each fingerprint, written, so that a join of many rows of one
    fingerprint has plain shuffles on both sides, which Spark can split."""
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = link(each.select("fp"), radius)
    of = materialize(each.join(roots, each.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = materialize(of.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return materialize(of.join(least, "root").select("fp", "root", "component_id"), "groups")


def near_groups(documents: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""
    rows = materialize(fingerprint(documents, width), "fingerprints")
    found = rows.join(_grouped(rows, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@plain_names
def keep_one(documents: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component, that of the smallest id, with all columns.  Rows without an id stand under a hash of their
    text; of rows with one id and text one stays."""
    named = documents.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "__text": F.xxhash64("text")})
    rows = materialize(fingerprint(named.select(F.col("__id").alias("doc_id"), "text", "__text"), width, "__text"), "fingerprints")
    first = rows.join(_grouped(rows, radius), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "__text")).alias("c"))
    chosen = first.select(F.col("c.doc_id").alias("__id"), F.col("c.__text").alias("__text"))
    return named.join(chosen, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select(*documents.columns)
