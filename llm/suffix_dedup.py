"""Repeated-substring removal by a distributed difference-cover algorithm.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus (same document included; the
occurrences may overlap; no string crosses documents).  Sorting every suffix would shuffle each byte many times over, so the
difference cover is used with discarding, and only as deep as `length` bytes:

1. Sample.  D is a perfect difference cover modulo v = q * q + q + 1 (Singer's construction).  Two equal strings starting at i and
   j have exactly one offset d < v (if i - j is not a multiple of v) at which both i + d and j + d are sampled, and there at least
   `length - v + 1` bytes agree.  Those tuples of bytes are sorted by name (a 64-bit hash); a name found once is discarded.
2. Names of longer strings settle whole runs of starts at once.  A run is the starts p - hi .. p - lo around a sampled p; its hull
   (the union of their strings) found twice makes every start in it a repeat, its core (their intersection) found once makes none.
   Runs neither settled nor dead split into shorter ones: this recursion on names ends at runs of one start.
3. The remaining suffixes are merged through the sampled one they meet first: a start's string is named by that sample and the
   bytes before it, and equal neighbours in name order are the repeats.

Every level is one shuffle of names, packed per bucket.  Copies are combined before the shuffle: a task sends one name for all
its equal hulls, and rows of equal doc_id and text are one with a count.  Texts are dealt once, into a bucketed table; the levels
bring their open runs there.

Defined results: null or empty text has no bytes and nothing removed; a document shorter than `length` loses nothing; equal
documents of at least `length` bytes lose everything, repeated rows too (each row counts as a document); rows with equal doc_id but
other text are judged each by its own bytes; extra columns are kept by `remove_repeats` and ignored by `repeated_bytes`.  Removed
bytes may cut a code point: `remove_repeats` then drops the fragments of that code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import U64, SpanHash, WordHash, dealt, gather, importable, lean, materialize, mix, partitions, pieces, plain_names, row_names, text_slices, word_spans


def difference_cover(q: int) -> np.ndarray:
    """Singer's perfect difference set modulo q * q + q + 1 for a prime q: the powers of a generator of GF(q ** 3) that lie in a
    plane.  Every non-zero residue is the difference of exactly one pair."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x ** 3 = a x ** 2 + b x + c
                x, seen, plane = (1, 0, 0), set(), []
                for i in range(v):
                    point = _line(x, q)
                    if point in seen:
                        break
                    seen.add(point)
                    if x[2] == 0:
                        plane.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                else:
                    if len({(s - t) % v for s in plane for t in plane}) == v:
                        return np.array(plane)
    raise ValueError("q is not a prime")


def _line(x: tuple[int, ...], q: int) -> tuple[int, ...]:
    """The point of the projective plane that x stands for."""
    lead = next(y for y in reversed(x) if y)
    inverse = pow(lead, -1, q)
    return tuple(y * inverse % q for y in x)


class Plan:
    """Numbers that follow from the length: the period, the sampled places, the bytes that name a tuple, and the widths of runs."""

    def __init__(self, length: int = 400, fan: int = 7):
        if length < 16:
            raise ValueError("length must be 16 at least")
        primes = [q for q in range(2, 60) if all(q % i for i in range(2, q)) and q * q + q + 1 <= length * 4 // 5]
        self.length, self.q = length, primes[-1]
        self.period = self.q**2 + self.q + 1
        self.cover = np.sort(difference_cover(self.q))
        self.tuple = length - self.period + 1
        self.widths = [self.period]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fan))

    def places(self, most: int) -> np.ndarray:
        """The sampled places of a document below `most`."""
        whole = (np.arange(0, most, self.period)[:, None] + self.cover).ravel()
        return whole[: np.searchsorted(whole, most)]


KINDS = [("core", U64), ("hull", U64), ("twice", np.bool_), ("id", np.int64), ("tie", np.int64), ("pos", np.int32), ("lo", np.int16)]
PACKED = "bucket int, " + ", ".join(f"{n} binary" for n, _ in KINDS)
#: state 1: every start of the run repeats; 2: the run is to be split; 3: both (a copy that stands for its class in the split).
SETTLED = "id long, tie long, pos int, lo short, state byte"
#: Texts are hashed by so many bytes at a time, which caches of processors hold; a task sends what it has of so many names at least.
SLICE, FLUSH = 1 << 18, 1 << 18
DIRECT = -1  #: lo of a record that its own task has settled; -2 - lo keeps the run


def names(plan: Plan, level: int, spans: tuple[SpanHash, SpanHash], offsets: np.ndarray, rows: dict[str, np.ndarray], row: np.ndarray, pos: np.ndarray, lo: np.ndarray) -> dict[str, np.ndarray]:
    """Names of the runs that start `lo` .. `lo + width - 1` bytes before sampled places `pos` of rows; rows: id, tie and whether there are
    copies.  The hull counts only starts that the document has, and its name holds how far they reach; the core needs no cut.  The
    two names come from independent hashes, so records that share both (124 bits) have equal strings."""
    begin, size = offsets[row], np.diff(offsets)[row]
    hi = lo + np.minimum(plan.widths[level], plan.period - lo) - 1
    own_lo, own_hi = np.maximum(lo, pos + plan.length - size), np.minimum(hi, pos)
    some = np.flatnonzero(own_lo <= own_hi)
    begin, row, pos, lo, hi, own_lo, own_hi = (x[some] for x in (begin, row, pos, lo, hi, own_lo, own_hi))
    at = begin + pos
    core = spans[0](at - lo, at - hi + plan.length) ^ mix(lo + (level << 16))
    hull = mix(spans[1](at - own_hi, at - own_lo + plan.length) + mix(own_lo * 65_536 + own_hi)) | U64(1)
    return {"core": core, "hull": hull, "twice": rows["copies"][row] > 1, "id": rows["id"][row], "tie": rows["tie"][row], "pos": pos.astype(np.int32), "lo": lo.astype(np.int16)}


def _take(rec: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {n: x[at] for n, x in rec.items()}


def _join(recs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([r[n] for r in recs]) if recs else np.zeros(0, k) for n, k in KINDS}


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of equal neighbours."""
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]).astype(np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _repeated(rec: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(records whose core occurs once, the others sorted by core and hull)."""
    order = np.argsort(rec["core"])
    core = rec["core"][order]
    same = core[1:] == core[:-1]
    more = np.zeros(len(order), bool)
    more[1:] |= same
    more[:-1] |= same
    rest = order[more]
    return order[~more], rest[np.lexsort((rec["hull"][rest], rec["core"][rest]))]


def _pack(rec: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, each field as the bytes of an array; lost executors cost nothing but the task."""
    order = np.argsort(bucket, kind="stable")
    start, size = _runs(bucket[order])
    cuts = np.append(start, len(order))
    columns = [pa.array(bucket[order][start].astype(np.int32))]
    for name, kind in KINDS:
        flat = np.ascontiguousarray(rec[name][order].astype(kind, copy=False))
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cuts * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)]))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *(n for n, _ in KINDS)])


def combine(rec: dict[str, np.ndarray], plan: Plan, buckets: int) -> pa.RecordBatch | None:
    """Before the shuffle: of equal (core, hull) one stays, marked as found twice.  All of them repeat already, so they go along as
    settled records, dealt out by document.  Those that share a residue other than the first are not needed even so: their
    strings meet at the first residue as well."""
    if not len(rec["core"]):
        return None
    once, rest = _repeated(rec)
    parts = [_take(rec, once)]
    if len(rest):
        more = _take(rec, rest)
        start, size = _runs(more["core"] + mix(more["hull"]))
        more["twice"] = more["twice"] | np.repeat(size > 1, size)
        parts.append(_take(more, start))
        residue = more["pos"] % plan.period
        needed = np.repeat((np.minimum.reduceat(residue, start) != np.maximum.reduceat(residue, start)) | (residue[start] == plan.cover[0]), size)
        direct = _take(more, np.flatnonzero(np.repeat(size > 1, size) & needed))
        direct["lo"] = (-2 - direct["lo"]).astype(np.int16)
        direct["core"] = mix(direct["id"]) ^ mix(direct["tie"])
        parts.append(direct)
    out = _join(parts)
    return _pack(out, ((out["core"] >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64))


def settle(rec: dict[str, np.ndarray], plan: Plan, last: bool) -> dict[str, np.ndarray]:
    """What the names of whole buckets say of each record that is not discarded."""
    direct = rec["lo"] < 0
    out = [_take(rec, np.flatnonzero(direct))]
    out[0]["lo"] = (-2 - out[0]["lo"]).astype(np.int16)
    states = [np.ones(len(out[0]["lo"]), np.int8)]
    rec = _take(rec, np.flatnonzero(~direct))
    once, rest = _repeated(rec) if len(rec["core"]) else (np.zeros(0, np.int64),) * 2
    if len(once):
        alone = _take(rec, once[rec["twice"][once]])
        residue = alone["pos"] % plan.period
        out.append(_take(alone, np.flatnonzero(residue == plan.cover[0])))
        states.append(np.ones(len(out[-1]["lo"]), np.int8))
    if len(rest):
        more = _take(rec, rest)
        start, size = _runs(more["core"] + mix(more["hull"]))
        twice = np.repeat(np.logical_or.reduceat(more["twice"], start) | (size > 1), size)
        head = np.zeros(len(rest), bool)
        head[start] = True
        group, members = _runs(more["core"])
        residue = more["pos"] % plan.period
        low, high = np.minimum.reduceat(residue, group), np.maximum.reduceat(residue, group)
        needed = np.repeat((low != high) | (low == plan.cover[0]), members)
        state = (twice & needed).astype(np.int8)
        if not last:
            varied = (np.add.reduceat(head.astype(np.int64), group) > 1) & np.logical_or.reduceat(~twice, group)
            state[head & needed & np.repeat(varied, members)] += 2
        at = np.flatnonzero(state)
        out.append(_take(more, at))
        states.append(state[at])
    return _join(out) | {"state": np.concatenate(states)}


def _settle_batches(plan: Plan, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows; every bucket lies whole in one partition."""
        recs = [{n: np.frombuffer(b"".join(batch.column(n).to_pylist()), k) for n, k in KINDS} for batch in batches]
        if recs:
            rec = _join(recs)
            recs.clear()
            out = settle(rec, plan, last)
            fields = [c.split()[0] for c in SETTLED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in fields], names=fields)

    return run


def _units(batch: pa.RecordBatch, words: bool) -> Iterator[tuple[dict[str, np.ndarray], tuple[SpanHash, SpanHash], np.ndarray, int]]:
    """(names of the rows, two hashes of spans, offsets, first row) of slices of a batch, in bytes or in words."""
    whole = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie", "copies")}
    for first, last, buf, offsets in text_slices(batch, "text", SLICE):
        both = tuple(SpanHash(buf, second) for second in (False, True))
        if words:
            starts, ends, rows = word_spans(buf, offsets)
            offsets = np.searchsorted(rows, np.arange(last - first + 1))
            both = tuple(WordHash(h(starts, ends), second) for second, h in enumerate(both))
        yield {c: x[first:last] for c, x in whole.items()}, both, offsets, first


def _sample(plan: Plan, buckets: int, words: bool = False, flush: int = FLUSH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of the sampled tuples, which are the cores of the widest runs."""
        held, n = [], 0
        for batch in batches:
            for rows, spans, offsets, _ in _units(batch, words):
                size = np.diff(offsets)
                places = plan.places(int(size.max(initial=0)))
                counts = np.where(size >= plan.length, np.searchsorted(places, size - plan.tuple, "right"), 0)
                pos = gather(places, np.zeros(len(size), np.int64), counts)
                held.append(names(plan, 0, spans, offsets, rows, np.repeat(np.arange(len(size)), counts), pos, np.zeros(len(pos), np.int64)))
                n += len(pos)
                if n >= flush:
                    if (out := combine(_join(held), plan, buckets)) is not None:
                        yield out
                    held, n = [], 0
        if held and (out := combine(_join(held), plan, buckets)) is not None:
            yield out

    return run


def _lists(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, fields) of the structs in a column of arrays of structs."""
    column = batch.column(name)
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return row, [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def _split(plan: Plan, level: int, buckets: int, words: bool = False, flush: int = FLUSH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of the parts of the open runs, at this level."""
        for batch in batches:
            row_of, (pos_of, lo_of) = _lists(batch, "open", ("pos", "lo"))
            held, n = [], 0
            for rows, spans, offsets, first in _units(batch, words):
                own = slice(*np.searchsorted(row_of, [first, first + len(offsets) - 1]))
                row, pos, lo = row_of[own] - first, pos_of[own], lo_of[own]
                fan = -(-plan.widths[level - 1] // plan.widths[level])
                part = np.repeat(lo, fan) + np.tile(np.arange(fan), len(lo)) * plan.widths[level]
                row, pos = np.repeat(row, fan), np.repeat(pos, fan)
                inside = part < np.minimum(np.repeat(lo, fan) + plan.widths[level - 1], plan.period)
                row, pos, part = row[inside], pos[inside], part[inside]
                if len(row):
                    held.append(names(plan, level, spans, offsets, rows, row, pos, part))
                    n += len(row)
                if n >= flush:
                    if (out := combine(_join(held), plan, buckets)) is not None:
                        yield out
                    held, n = [], 0
            if held and (out := combine(_join(held), plan, buckets)) is not None:
                yield out

    return run


NAME = ["id", "tie"]


def deal_texts(documents: DataFrame) -> DataFrame:
    """id, tie, doc_id, text, copies (how many rows have that doc_id and text), dealt by name: texts move once, and every level
    brings its open runs to them."""
    importable(documents.sparkSession)
    rows = documents.select(*row_names(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dealt(rows.groupBy(*NAME).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")), "texts", *NAME)


def find_repeats(docs: DataFrame, length: int = 400, words: bool = False) -> DataFrame:
    """id, tie, runs: for each of the dealt texts that has any, the runs of starts whose strings of `length` bytes (or words) occur
    elsewhere."""
    plan, n = Plan(length), partitions(docs.sparkSession)
    named, found = docs.select(*NAME, "text", "copies").mapInArrow(lean(_sample(plan, n, words)), PACKED), []
    for level, width in enumerate(plan.widths):
        last = level == len(plan.widths) - 1
        settled = materialize(named.repartitionById(n, "bucket").mapInArrow(lean(_settle_batches(plan, last)), SETTLED), f"repeats{level}")
        found.append(settled.where("state % 2 = 1").select(*NAME, "pos", "lo", F.lit(width).alias("width")))
        if not last:
            opened = settled.where("state >= 2").distinct().groupBy(*NAME).agg(F.collect_list(F.struct("pos", "lo")).alias("open"))
            named = docs.join(opened, NAME).select(*NAME, "text", "copies", "open").mapInArrow(lean(_split(plan, level + 1, n, words)), PACKED)
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    return runs.distinct().groupBy(*NAME).agg(F.collect_list(F.struct("pos", "lo", "width")).alias("runs"))


def _covered(plan: Plan, size: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
    """True for each byte of the buffer that goes."""
    hi = np.minimum(lo + np.minimum(width, plan.period - lo) - 1, pos)
    lo = np.maximum(lo, pos + plan.length - size[row])
    step = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(step, offsets[row] + pos - hi, 1)
    np.add.at(step, offsets[row] + pos - lo + plan.length, -1)
    return np.cumsum(step[:-1]) > 0


def _runs_of(docs: DataFrame, length: int, words: int | None) -> DataFrame:
    """id, tie, __runs, __word_runs of the dealt texts."""
    runs = find_repeats(docs, length).withColumnRenamed("runs", "__runs")
    if words:
        return runs.join(find_repeats(docs, words, words=True).withColumnRenamed("runs", "__word_runs"), NAME, "full")
    return runs.withColumn("__word_runs", F.lit(None).cast(runs.schema["__runs"].dataType))


def _each(batch: pa.RecordBatch, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, whether each byte goes) of slices of a batch."""
    row_of, (pos, lo, width) = _lists(batch, "__runs", ("pos", "lo", "width"))
    for first, last, buf, offsets in text_slices(batch, "text", SLICE):
        own = slice(*np.searchsorted(row_of, [first, last]))
        yield first, buf, offsets, _covered(plan, np.diff(offsets), offsets, row_of[own] - first, pos[own], lo[own], width[own])


def _count_spans(gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many are True, maximal runs of them) in each row."""
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    edge = offsets[1:-1][(offsets[1:-1] < len(gone)) & (offsets[1:-1] > 0)]
    starts[edge] |= gone[edge]
    return tuple(np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(np.int64) for x in (gone, starts))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long"


def repeated_bytes(documents: DataFrame, length: int = 400, words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; n_passage_words, n_passages: the words in runs of `words` words that occur
    elsewhere too, however few bytes they have, and the maximal stretches of such words.  One row per document."""
    plan, word_plan, fields = Plan(length), Plan(words), [c.split()[0] for c in DIGEST.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            more = _passage_words(batch, word_plan)
            for first, buf, offsets, gone in _each(batch, plan):
                n = len(offsets) - 1
                removed, spans = _count_spans(gone, offsets)
                covered, cuts = next(more)[:2]
                sha = [hashlib.sha256(part if not r else part[~gone[a:b]]).hexdigest() for a, b, r in zip(offsets[:-1], offsets[1:], removed) for part in (buf[a:b],)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), *map(pa.array, (np.diff(offsets), removed, spans, sha, *_count_spans(covered, cuts))), batch.column("copies").slice(first, n)], names=[*fields, "copies"])

    docs = deal_texts(documents)
    rows = docs.join(_runs_of(docs, length, words), NAME, "left").select("doc_id", "text", "copies", "__runs", "__word_runs")
    done = rows.mapInArrow(lean(digest), f"{DIGEST}, copies long")
    return done.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(*fields)


def _passage_words(batch: pa.RecordBatch, plan: Plan) -> Iterator[tuple[np.ndarray, ...]]:
    """(whether each word is covered, where each row's words begin, starts, ends, rows) of the slices of a batch."""
    row_of, (pos, lo, width) = _lists(batch, "__word_runs", ("pos", "lo", "width"))
    for first, last, buf, offsets in text_slices(batch, "text", SLICE):
        own = slice(*np.searchsorted(row_of, [first, last]))
        starts, ends, rows = word_spans(buf, offsets)
        cuts = np.searchsorted(rows, np.arange(last - first + 1))
        yield _covered(plan, np.diff(cuts), cuts, row_of[own] - first, pos[own], lo[own], width[own]), cuts, starts, ends, rows


def _covered_words(batch: pa.RecordBatch, plan: Plan, buf_sizes: Iterator[int]) -> Iterator[np.ndarray]:
    """Whether each byte goes with its words, of the slices of a batch: those of covered words, and between them."""
    for (covered, _, starts, ends, rows), size in zip(_passage_words(batch, plan), buf_sizes):
        at = np.flatnonzero(covered)
        stop = ends[at]
        on = np.flatnonzero((at[1:] == at[:-1] + 1) & (rows[at[1:]] == rows[at[:-1]]))
        stop[on] = starts[at[on + 1]]
        step = np.zeros(size + 1, np.int64)
        np.add.at(step, starts[at], 1)
        np.add.at(step, stop, -1)
        yield np.cumsum(step[:-1]) > 0


@plain_names
def remove_repeats(documents: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """The documents without their repeated bytes, all columns kept (n_chars, where there is one, counts anew); with `words`, runs of
    so many words that occur elsewhere go as well, however short they are and whatever white space parts them.  Documents that lose
    every byte (or word) go; those without text before stay."""
    plan, schema = Plan(length), documents.schema
    word_plan = Plan(words) if words else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, keep = [], []
            slices = list(_each(batch, plan))
            more = _covered_words(batch, word_plan, (len(buf) for _, buf, _, _ in slices)) if words else None
            for first, buf, offsets, gone in slices:
                if words:
                    gone = gone | next(more)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    lost = gone[a:b].any()
                    texts.append(buf[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if lost else batch.column("text")[first + i].as_py())
                    keep.append(not lost or bool(texts[-1].strip() if words else texts[-1]))
            columns = {f.name: batch.column(f.name) for f in batch.schema if f.name not in ("__runs", "__word_runs")}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=schema.fieldNames()).filter(pa.array(keep))

    docs = deal_texts(documents)
    runs = _runs_of(docs, length, words).withColumnsRenamed({"id": "__id", "tie": "__tie"})
    name = [c.alias(f"__{n}") for c, n in zip(row_names(), NAME)]
    return documents.select("*", *name).join(runs, ["__id", "__tie"], "left").select(*documents.columns, "__runs", "__word_runs").mapInArrow(lean(cut), schema)
