"""Line dedup by pairwise alignment: documents that share rare lines are aligned with patience diff, and the aligned common blocks
go from the later document.

Pairs.  Keys are windows: the fewest lines from (or up to) any line that make `min_block_bytes`, whatever the length of each and however
often they occur; every block that two documents have in common holds one.  If at most `rare` documents have a window, each is paired
with all earlier ones.  What more have is paired with the window's first holder; with the first that has it once, if the document has it
once, so that it can be an anchor on both sides; and with the first that begins, or ends, with it, if the document does, since equal ends
are aligned whatever their lines.  So pairs number as windows, however many documents share one, and no shared block goes unseen.  (What
lines that repeat within a document are aligned with depends on the partner; at sf0.01 all pairs that share a window give the same
deletions.)

Alignment.  The whole lines of both documents are matched: equal lines at both ends, then the longest increasing run of lines that
occur once on either side, and the same again within every gap between these.  Lines matched one after another in both documents
are a block; blocks of `min_block_bytes` or more go from the later one, whatever the length of their single lines.  What is left is
aligned again till no block is found, so that it does not matter in which order the partner at hand has the blocks.  The partners of a
document with very many are dealt to several tasks, and what each finds is united.

Defined results: documents are ordered by doc_id (null before all, ties by a hash of the text); repeated rows with one doc_id and
text are one document and keep their lines; null and empty texts have one empty line and stay; lines are compared by 124-bit
hashes; a line of any length and a text of any number of lines are taken whole, in one task; of a document that several earlier ones
overlap, all that any of them has goes; extra columns of any name are kept by `remove_lines`, which drops documents left without a non-blank
line; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import U64, SpanHash, WordHash, discard, importable, lean, line_spans, materialize, partitions, plain_names, row_names, text_slices


@dataclass(frozen=True)
class Parameters:
    min_block_bytes: int = 40
    rare: int = 5
    #: Partners of a document that one task aligns.
    partners_per_task: int = 100


NAME = ["known", "id", "tie"]  #: their order is that of the documents
SEQUENCES = "known boolean, id long, tie long, hashes binary, sizes binary"
KEYS = "known boolean, id long, tie long, key long, single boolean"
#: Added to the keys of windows that begin or end a document.
_BEGIN, _END = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def sequences(documents: DataFrame) -> DataFrame:
    """One row for each document: hashes (two of 64 bits) and bytes (32 bits) of its lines, packed."""
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in text_slices(batch, "text"):
                starts, ends, rows = line_spans(buf, offsets)
                cuts = np.searchsorted(rows, np.arange(last - first + 1))
                hashes = np.stack([SpanHash(buf, second)(starts, ends) for second in (False, True)], axis=1)
                sizes = (ends - starts).astype(np.int32)
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (hashes, sizes)]
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in NAME), *packed], names=[*NAME, "hashes", "sizes"])

    rows = documents.select(F.col("doc_id").isNotNull().alias("known"), *row_names(), "text").mapInArrow(lean(run), SEQUENCES)
    return rows.groupBy(*NAME).agg(F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many each row has)."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(x) for x in parts], np.int64)


def keys(lines: DataFrame, p: Parameters) -> DataFrame:
    """The windows of each document; single: it has this one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = _unpacked(batch.column("hashes"), np.uint64)
            hashes, counts = hashes[::2], counts // 2
            sizes = _unpacked(batch.column("sizes"), np.int32)[0].astype(np.int64)
            rows = np.repeat(np.arange(len(counts)), counts)
            row_end = np.cumsum(counts)
            row_begin = row_end - counts
            total = np.concatenate([[0], np.cumsum(sizes)])
            fewest = lambda at: np.searchsorted(total, total[at] + p.min_block_bytes)
            latest = lambda at: np.searchsorted(total, total[at] - p.min_block_bytes, "right") - 1
            at = np.flatnonzero(sizes > 0)
            begin, end, row = np.concatenate([at, latest(at + 1)]), np.concatenate([fewest(at), at + 1]), np.tile(rows[at], 2)
            whole = (begin >= row_begin[row]) & (end <= row_end[row])
            (begin, end), first = np.unique(np.stack([begin[whole], end[whole]]), axis=1, return_index=True)
            row, key = row[whole][first], WordHash(hashes)(begin, end)
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])[: len(key)])
            single = np.diff(np.append(start, len(key))) == 1
            parts = [(row[start], key[start], single)]
            for cut, salt in ((fewest(row_begin), _BEGIN), (latest(row_end), _END)):
                a, b = (row_begin, cut) if salt == _BEGIN else (cut, row_end)
                own = np.flatnonzero((a >= row_begin) & (b <= row_end))
                parts.append((own, WordHash(hashes)(a[own], b[own]) + salt, np.zeros(len(own), bool)))
            row, key, single = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in NAME), pa.array(key.view(np.int64)), pa.array(single)], names=[c.split()[0] for c in KEYS.split(", ")])

    return lines.mapInArrow(lean(run), KEYS)


def pairs(lines: DataFrame, p: Parameters) -> DataFrame:
    """doc, other (structs of a document's name): the documents to be aligned, the earlier one as other."""
    doc = F.struct(*NAME).alias("doc")
    held = materialize(keys(lines, p).select("key", "single", doc), "keys")
    # written, so that both sides of the joins are plain shuffles, of which Spark can split a frequent key's
    firsts = held.groupBy("key").agg(F.min("doc").alias("first"), F.min(F.when(F.col("single"), F.col("doc"))).alias("first_single"), F.count("*").alias("holders"))
    shared = materialize(firsts.where("holders > 1"), "shared")
    met = held.join(shared, "key")
    partners = F.array("first", F.when(F.col("single"), F.col("first_single")))
    stars = met.select("doc", F.explode(partners).alias("other")).where("other < doc")
    few = met.where(F.col("holders") <= p.rare).groupBy("key").agg(F.collect_list("doc").alias("docs"))
    all_ = few.select(F.explode("docs").alias("doc"), "docs").select("doc", F.explode("docs").alias("other")).where("other < doc")
    out = materialize(stars.unionByName(all_).distinct(), "pairs")
    discard(held)
    discard(shared)
    return out


def longest_run(second: list[int]) -> list[int]:
    """Indexes of a longest increasing run of distinct numbers."""
    tails, at, before = [], [], [-1] * len(second)
    for i, b in enumerate(second):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Places of matched lines, in order in both."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, i_end, j, j_end = gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        count, other = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: k for k, x in enumerate(b[j:j_end], j) if other[x] == 1}
        once = [(k, place[x]) for k, x in enumerate(a[i:i_end], i) if x in place and count[x] == 1]
        kept = [once[k] for k in longest_run([y for _, y in once])]
        out += kept
        if kept:
            gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip([(i - 1, j - 1), *kept], [*kept, (i_end, j_end)])]
    return sorted(out)


def common_blocks(own: list, sizes: list[int], other: list, least: int) -> set[int]:
    """Places of own lines in aligned blocks of `least` bytes or more.  What a pass leaves is aligned again, till no block is found:
    so blocks that stand in another order in both documents go as well."""
    gone: set[int] = set()
    while True:
        before, block, last = len(gone), [], None
        left = [-1 - i if i in gone else x for i, x in enumerate(own)] if gone else own
        for i, j in [*patience(left, other), (-1, -1)]:
            if block and (i, j) != (last[0] + 1, last[1] + 1):
                if sum(sizes[k] for k in block) >= least:
                    gone.update(block)
                block = []
            block.append(i)
            last = (i, j)
        if len(gone) in (before, len(own)):
            return gone


def find_blocks(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """id, tie, lines: the places of the lines that go, for each document that loses any.

    A document's own lines and those of its partners, one after another, come sorted: a task holds one partner at a time."""
    lines = materialize(sequences(documents), "sequences")
    found = pairs(lines, p)
    tasks = found.groupBy("doc").agg(F.ceil(F.count("*") / p.partners_per_task).alias("tasks"))
    held = lines.select(F.struct(*NAME).alias("other"), "hashes", "sizes")
    partners = found.join(tasks, "doc").withColumn("task", F.pmod(F.xxhash64("other"), F.col("tasks"))).join(held, "other").select("doc", "task", F.lit(True).alias("partner"), "hashes", "sizes")
    own = held.join(tasks.withColumnRenamed("doc", "other"), "other").select(F.col("other").alias("doc"), F.explode(F.expr("sequence(0L, tasks - 1)")).alias("task"), F.lit(False).alias("partner"), "hashes", "sizes")
    both = own.unionByName(partners).select("doc.id", "doc.tie", "task", "partner", "hashes", "sizes")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, mine, sizes, gone = None, [], [], set()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([sorted(gone)], pa.list_(pa.int32()))], names=["id", "tie", "lines"])

        for batch in batches:
            for id_, tie, task, partner, hashes, size in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "task", "partner", "hashes", "sizes"))):
                hashes = np.frombuffer(hashes, "V16").tolist()  # as bytes, which are hashed and compared whole
                if not partner:
                    if gone:
                        yield row()
                    name, mine, sizes, gone = (id_, tie), hashes, np.frombuffer(size, np.int32).tolist(), set()
                elif len(gone) < len(mine):
                    gone.update(common_blocks(mine, sizes, hashes, p.min_block_bytes))
        if gone:
            yield row()

    aligned = both.repartition(partitions(documents.sparkSession), "id", "tie", "task").sortWithinPartitions("id", "tie", "task", "partner").mapInArrow(lean(align), "id long, tie long, lines array<int>")
    return aligned.groupBy("id", "tie").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def _with_lines(documents: DataFrame, p: Parameters, *columns: str) -> DataFrame:
    importable(documents.sparkSession)
    blocks = find_blocks(documents, p).toDF("__id", "__tie", "__lines")
    id_, tie = row_names()
    return documents.select(*columns, "text", id_.alias("__id"), tie.alias("__tie")).join(blocks, ["__id", "__tie"], "left").drop("__id", "__tie")


def deleted_lines(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_blocks (maximal deleted runs), kept_sha256 of what stays, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("__lines").to_pylist()):
                lines, drop = (text or "").split("\n"), set(gone or ())
                kept = [x for i, x in enumerate(lines) if i not in drop]
                out.append((len(lines), len(drop), sum(i - 1 not in drop for i in drop), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_lines", "n_deleted", "n_blocks", "kept_sha256"])

    rows = _with_lines(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), p, "doc_id")
    return rows.mapInArrow(lean(run), "doc_id long, n_lines long, n_deleted long, n_blocks long, kept_sha256 string")


@plain_names
def remove_lines(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents without the deleted lines, all columns kept (n_chars, where there is one, counts anew)."""
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("__lines").to_pylist()):
                if gone:
                    drop = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
                keep.append(not gone or bool(text.strip()))
            columns = {f.name: batch.column(f.name) for f in batch.schema if f.name != "__lines"}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=schema.fieldNames()).filter(pa.array(keep, pa.bool_()))

    return _with_lines(documents, p, *(c for c in documents.columns if c != "text")).select(*documents.columns, "__lines").mapInArrow(lean(run), schema)
