"""Hard negatives by exact search in a packed R-tree: for each anchor its best rows of the same label, and for each of these the best rows of
other labels whose score lies in a window below it.  A score is the inner product of two vectors of integers.

Index.  Rows are packed sort-tile-recursively.  Ranges of (label, the coordinates of greatest variance, id) are slabs, a task each, however
many rows have one label or one vector; a slab is sorted and cut in turn along one coordinate after another, down to pages.  A page is a
row of a table: its vectors, and its bounding box, which has the labels as a coordinate of its own and the least id.  Slabs have boxes
made of those of their pages.

Search.  With an anchor's vector every coordinate of a box is an interval of products, and their sums bound the scores of all in the box.
A box is pruned if its labels do not fit, if its interval lies outside all windows, or if the best it could hold, by score and then id, is
below what is held as last.  An anchor first searches the slab with the greatest bound; what it finds there prunes the other slabs.
Within a slab it takes pages from a queue, the greatest bound first, a few at a time, till none is left that could add a row.

What moves.  Anchors go to slabs, not rows to anchors: a task reads a slab's pages, then its anchors one batch after another.  Boxes of
slabs are compared with anchors in blocks of `boxes_per_block`.  No task holds the tree, and nothing is broadcast or collected but the
variance of each coordinate.  (With independent coordinates in high dimension boxes overlap and most of them have to be opened; the answer is
exact all the same.)

Defined results: rows without label, vector or with a null component take no part; a shorter vector counts as filled up with zeros; rows
without id come last among equal scores and are no anchors; of repeated rows each is a row, and a repeated anchor is answered each time; an anchor
without partners gives no row; an empty table gives an empty one.  Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import discard, importable, materialize, partitions

LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Parameters:
    positives: int = 5
    negatives: int = 3
    #: A negative has from low to high hundredths of the positive's score.
    low: int = 50
    high: int = 95
    rows_per_page: int = 256
    rows_per_slab: int = 16_384
    boxes_per_block: int = 256


@dataclass(frozen=True)
class Shape:
    """Of the vectors: their width, coordinates by falling variance, and the type that holds every component and the one for scores."""

    width: int
    order: tuple[int, ...]
    stored: str
    scored: str
    rows: int


def shape(rows: DataFrame) -> Shape:
    total, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    found = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("spread"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # one row for each coordinate
    most = max([1, *(max(-r.lo, r.hi) for r in found)])
    order = [r.at for r in sorted(found, key=lambda r: (-r.spread, r.at))]
    stored = next(t for t in ("int16", "int32", "int64") if most <= np.iinfo(t).max)
    return Shape(width or 0, tuple(order), stored, "float64" if most * most * (width or 1) < 1 << 53 else "int64", total)


def _tiles(at: np.ndarray, vectors: np.ndarray, order: tuple[int, ...], page: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: pages of the rows `at`, which are sorted along one coordinate and cut into slices, and these along the next."""
    pages = -(-len(at) // page)
    if pages <= 1 or not order:
        for i in range(0, len(at), page):
            yield at[i : i + page]
        return
    at = at[np.argsort(vectors[at, order[0]], kind="stable")]
    left = max(1, min(len(order), int(pages).bit_length() - 1))
    size = page * -(-pages // max(2, round(pages ** (1 / left))))
    for i in range(0, len(at), size):
        yield from _tiles(at[i : i + size], vectors, order[1:], page)


PAGE = "slab int, start int, label_lo long, label_hi long, id_lo long, lo binary, hi binary, labels binary, ids binary, known binary, anchors binary, vectors binary"


def index(rows: DataFrame, s: Shape, p: Parameters) -> DataFrame:
    """The pages of all rows (id, label, vector, anchor).  The place of a row in its slab is its name: slab * 2 ** 32 + place."""
    slabs = max(1 + s.rows // p.rows_per_slab, partitions(rows.sparkSession))
    named = rows.select(F.coalesce("id", F.lit(GREATEST)).alias("id"), F.col("id").isNotNull().alias("known"), "label", "vector", "anchor", F.monotonically_increasing_id().alias("tie"))
    ranged = named.repartitionByRange(slabs, "label", *(F.get("vector", F.lit(c)) for c in s.order[:3]), "id", "tie").select(F.spark_partition_id().alias("slab"), "*")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        label, ids, known, anchor, vector = get("label"), get("id"), get("known"), get("anchor"), table.column("vector").combine_chunks()
        vectors = np.zeros((len(label), s.width), s.stored)
        sizes = vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        vectors[np.repeat(np.arange(len(label)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vector.flatten().to_numpy()
        order = np.lexsort((ids, label))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(label[order])) + 1, [len(order)]])
        small, groups = [], []  # labels of a few rows share pages
        for a, b in zip(cuts[:-1], cuts[1:]):
            (groups if b - a > p.rows_per_page // 4 else small).append(order[a:b])
        pages = [t for g in groups for t in _tiles(g, vectors, s.order, p.rows_per_page)]
        few = np.concatenate(small) if small else order[:0]
        pages += [few[i : i + p.rows_per_page] for i in range(0, len(few), p.rows_per_page)]
        slab, start = table.column("slab")[0].as_py(), 0
        for at in pages:
            v = vectors[at]
            blobs = [v.min(axis=0), v.max(axis=0), label[at], ids[at], known[at], anchor[at], v]
            numbers = [pa.array([x], t) for x, t in zip((slab, start, label[at].min(), label[at].max(), ids[at].min()), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*numbers, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=[c.split()[0] for c in PAGE.split(", ")])
            start += len(at)

    return materialize(ranged.mapInArrow(pack, PAGE), "pages")


def _stacked(column: pa.Array, kind: str, width: int, rows: int | None = None) -> np.ndarray:
    """Packed vectors as rows of a matrix; rows: their number, where one value holds several."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1 if width else len(column) if rows is None else rows, width)


def boxes(pages: DataFrame, s: Shape, p: Parameters) -> DataFrame:
    """block, slab, label_lo, label_hi, lo, hi: the boxes of the slabs."""

    def merge(table: pa.Table) -> pa.Table:
        lo, hi = _stacked(table.column("lo"), s.stored, s.width).min(axis=0), _stacked(table.column("hi"), s.stored, s.width).max(axis=0)
        label = [table.column("label_lo").to_numpy().min(), table.column("label_hi").to_numpy().max()]
        return pa.table([table.column("slab")[:1], *(pa.array([x], pa.int64()) for x in label), pa.array([lo.tobytes()], pa.binary()), pa.array([hi.tobytes()], pa.binary())], names=["slab", "label_lo", "label_hi", "lo", "hi"])

    merged = pages.select("slab", "label_lo", "label_hi", "lo", "hi").groupBy("slab").applyInArrow(merge, "slab int, label_lo long, label_hi long, lo binary, hi binary")
    return merged.select(F.expr(f"slab div {p.boxes_per_block}").cast("int").alias("block"), "*")


def anchors_of(pages: DataFrame, s: Shape) -> DataFrame:
    """row, id, label, vector (packed) of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["anchors"], bool) & np.frombuffer(r["known"], bool))
                ids, label = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                v = _stacked(pa.array([r["vectors"]]), s.stored, s.width, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array((r["slab"] << 32) + r["start"] + at), pa.array(ids[at]), pa.array(label[at]), pa.array([v[i].tobytes() for i in at], pa.binary())], names=["row", "id", "label", "vector"])

    return pages.select("slab", "start", "known", "anchors", "ids", "labels", "vectors").mapInArrow(run, "row long, id long, label long, vector binary")


class Boxes:
    """Boxes side by side, for bounds of scores."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray, kind: str):
        self.lo, self.hi, self.label_lo, self.label_hi = lo.astype(kind), hi.astype(kind), label_lo, label_hi

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of each vector with anything in each box."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T

    def fit(self, label: int, same: bool) -> np.ndarray:
        inside = (self.label_lo <= label) & (label <= self.label_hi)
        return inside if same else ~(inside & (self.label_lo == self.label_hi))


def _needed(least: np.ndarray, greatest: np.ndarray, id_lo: np.ndarray | int, windows: np.ndarray) -> np.ndarray:
    """Boxes that may hold a row for one of the windows (lo, hi, and score and id of what is held as last)."""
    lo, hi, score, last = (windows[:, k, None] for k in range(4))
    best = np.minimum(greatest, hi)
    return ((greatest >= lo) & (least <= hi) & ((best > score) | (best == score) & (id_lo < last))).any(axis=0)


FIELDS = ["row", "label", "vector", "windows", "first"]
ASK = "row long, label long, vector binary, windows array<struct<lo: bigint, hi: bigint, score: bigint, id: bigint>>, first int"  #: first: a slab that was searched before, or -1


def _windows(column: pa.Array) -> list[np.ndarray]:
    """Rows of lo, hi, score, id for each ask."""
    cuts, flat = column.offsets.to_numpy(), column.flatten()
    return np.split(np.stack([flat.field(k).to_numpy() for k in range(4)], axis=1), (cuts - cuts[0])[1:-1])


def _streamed(heads: DataFrame, asks: DataFrame, part: str, run: Callable, schema: str) -> DataFrame:
    """Each part's heads, then its asks, batch by batch, through run(heads: list of rows, asks: batch)."""
    names = [c for c in asks.columns if c not in heads.columns]
    own = heads.columns
    mine = [c for c in own if c not in asks.columns]
    kinds = {f.name: f.dataType for f in [*heads.schema, *asks.schema]}
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = heads.select(*heads.columns, *(null(c) for c in names), F.lit(False).alias("ask")).unionByName(asks.select(*asks.columns, *(null(c) for c in mine), F.lit(True).alias("ask")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, made = [], None, None
        for batch in batches:
            parts, ask = batch.column(part).to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(parts) != 0) | (np.diff(ask.astype(np.int8)) != 0)) + 1, [len(parts)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if not ask[a]:
                    if of != parts[a] or made is not None:
                        held, of, made = [], parts[a], None
                    held += batch.slice(a, b - a).select(own).to_pylist()
                elif of == parts[a]:
                    made = made or run(held)
                    held = []
                    for i in range(a, b, 1024):
                        yield from made(batch.slice(i, min(1024, b - i)))

    n = partitions(heads.sparkSession)
    return both.repartitionById(n, part).sortWithinPartitions(part, "ask").mapInArrow(each, schema)


def _asked(anchors: DataFrame, boxes_: DataFrame, blocks: int, same: bool, best: bool, s: Shape) -> DataFrame:
    """ASK with the slabs that each anchor is to search: of each block the one with the greatest bound, or all that are needed."""
    salts = max(1, partitions(anchors.sparkSession) // blocks)
    heads = boxes_.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "block", "slab", "label_lo", "label_hi", "lo", "hi").select((F.col("block") * salts + F.col("salt")).alias("part"), "slab", "label_lo", "label_hi", "lo", "hi")
    asks = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *FIELDS).select((F.col("block") * salts + F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).alias("part"), *FIELDS)

    def run(held: list[dict]) -> Callable:
        lo, hi = (_stacked(pa.array([r[c] for r in held]), s.stored, s.width) for c in ("lo", "hi"))
        slabs = np.array([r["slab"] for r in held])
        own = Boxes(lo, hi, *(np.array([r[c] for r in held]) for c in ("label_lo", "label_hi")), s.scored)

        def answer(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            least, greatest = own.bounds(_stacked(batch.column("vector"), s.stored, s.width).astype(s.scored))
            rows, to, bound = [], [], []
            for i, (label, windows, first) in enumerate(zip(batch.column("label").to_pylist(), _windows(batch.column("windows")), batch.column("first").to_pylist())):
                fit = np.flatnonzero(own.fit(label, same) & (slabs != first) & _needed(least[i], greatest[i], LEAST, windows))
                if best and len(fit):
                    fit = fit[[np.argmax(greatest[i][fit])]]
                rows.append(np.full(len(fit), i))
                to.append(slabs[fit])
                bound.append(greatest[i][fit])
            at = pa.array(np.concatenate(rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), pa.array(np.concatenate(bound).astype(np.int64)), *(batch.column(c).take(at) for c in FIELDS)], names=["slab", "bound", *FIELDS])

        return answer

    return _streamed(heads, asks, "part", run, f"slab int, bound long, {ASK}")


FOUND = "row long, window int, score long, id long, known boolean, found long"


class Slab:
    """Pages in memory, and the search among them."""

    def __init__(self, held: list[dict], s: Shape):
        column = lambda c, t: [np.frombuffer(r[c], t) for r in held]
        lo, hi = (_stacked(pa.array([r[c] for r in held]), s.stored, s.width) for c in ("lo", "hi"))
        self.boxes = Boxes(lo, hi, *(np.array([r[c] for r in held]) for c in ("label_lo", "label_hi")), s.scored)
        self.id_lo = np.array([r["id_lo"] for r in held])
        self.label, self.ids, self.known = (np.concatenate(column(c, t)) for c, t in (("labels", np.int64), ("ids", np.int64), ("known", bool)))
        sizes = np.array([len(r["known"]) for r in held])
        self.vectors = _stacked(pa.array([r["vectors"] for r in held]), s.stored, s.width, len(self.ids)).astype(s.scored)
        self.names = np.concatenate([(r["slab"] << 32) + r["start"] + np.arange(n) for r, n in zip(held, sizes)])
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])

    def search(self, row: int, label: int, vector: np.ndarray, windows: np.ndarray, least: np.ndarray, greatest: np.ndarray, same: bool, k: int) -> list[list[tuple]]:
        """For each window the best k (-score, id, name, place) that beat what it holds as last."""
        best: list[list[tuple]] = [[] for _ in windows]
        windows = windows.copy()
        queue = np.flatnonzero(self.boxes.fit(label, same))
        queue = queue[np.lexsort((self.id_lo[queue], -greatest[queue]))]
        few = 1
        while len(queue := queue[_needed(least[queue], greatest[queue], self.id_lo[queue], windows)]):
            at = np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in queue[:few].tolist()])
            queue, few = queue[few:], 2 * few
            score = (self.vectors[at] @ vector).astype(np.int64)
            fit = ((self.label[at] == label) == same) & (self.names[at] != row) & (score >= windows[:, 0].min()) & (score <= windows[:, 1].max()) & (score >= windows[:, 2].min())
            at, score = at[fit], score[fit]
            order = np.lexsort((self.names[at], self.ids[at], -score))
            at, score = at[order], score[order]
            begin = np.searchsorted(-score, -windows[:, 1])
            for w, a in enumerate(begin.tolist()):
                new = [(-int(x), int(self.ids[i]), int(self.names[i]), int(i)) for x, i in zip(score[a : a + k], at[a : a + k]) if x >= windows[w, 0] and (x > windows[w, 2] or x == windows[w, 2] and self.ids[i] < windows[w, 3])]
                if new:
                    best[w] = sorted([*best[w], *new])[:k]
                    if len(best[w]) == k:
                        windows[w, 2:] = -best[w][-1][0], best[w][-1][1]
        return best


def _found(pages: DataFrame, asked: DataFrame, same: bool, k: int, s: Shape) -> DataFrame:
    """FOUND: the best k for each window of each anchor in each slab that it is to search."""

    def run(held: list[dict]) -> Callable:
        slab = Slab(held, s)

        def answer(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            vectors = _stacked(batch.column("vector"), s.stored, s.width).astype(s.scored)
            least, greatest = slab.boxes.bounds(vectors)
            out = []
            for i, (row, label, windows) in enumerate(zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), _windows(batch.column("windows")))):
                found = slab.search(row, label, vectors[i], windows, least[i], greatest[i], same, k)
                out += [(row, w, -x, id_, bool(slab.known[at]), name) for w, best in enumerate(found) for x, id_, name, at in best]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

        return answer

    return _streamed(pages.drop("anchors"), asked.select("slab", *FIELDS), "slab", run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k of each window, with their place (rank) from 1; a window has k rows of each slab at most."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(pages: DataFrame, boxes_: DataFrame, blocks: int, anchors: DataFrame, same: bool, k: int, s: Shape) -> DataFrame:
    """FOUND with rank: the best k for each window of anchors (row, label, vector, windows)."""
    asks = anchors.select("row", "label", "vector", "windows", F.lit(-1).alias("first"))
    nearest = _asked(asks, boxes_, blocks, same, True, s)
    nearest = nearest.groupBy("row").agg(F.max_by(F.struct("slab", "label", "vector", "windows", "first"), F.struct("bound", "slab")).alias("a")).select("row", "a.*")
    nearest = materialize(nearest, "nearest")
    begun = materialize(_found(pages, nearest, same, k, s), "begun")
    # a window that is full by now has a last one to beat
    last = begun.groupBy("row", "window").agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "id")).alias("last")).where(F.col("n") == k)
    held = last.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct((-F.col("last.s")).alias("score"), F.col("last.id").alias("id"))))).alias("held"))
    windows = F.transform("windows", lambda w, i: _with_last(w, F.try_element_at("held", i)))
    again = nearest.withColumn("first", F.col("slab")).drop("slab").join(held, "row", "left").withColumn("windows", windows).drop("held")
    more = _found(pages, _asked(again, boxes_, blocks, same, False, s), same, k, s)
    out = materialize(_first(begun.unionByName(more), k), "found")
    discard(nearest)
    discard(begun)
    return out


def _with_last(window: Column, last: Column) -> Column:
    return F.when(last.isNull(), window).otherwise(F.struct(window["lo"].alias("lo"), window["hi"].alias("hi"), last["score"].alias("score"), last["id"].alias("id")))


def mine(rows: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  rows: id long, label long, vector array<bigint>, anchor
    boolean (whether the row asks)."""
    importable(rows.sparkSession)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = rows.where("label is not null and vector is not null and not exists(vector, x -> x is null)")
    s = shape(rows)
    pages = index(rows, s, p)
    slab_boxes = materialize(boxes(pages, s, p), "boxes")
    blocks = 1 + max(s.rows // p.rows_per_slab, partitions(rows.sparkSession) - 1) // p.boxes_per_block
    anchors = materialize(anchors_of(pages, s), "anchors")
    bound = lambda x, name: F.lit(x).cast("long").alias(name)
    none = [bound(LEAST, "score"), bound(GREATEST, "id")]
    open_ = F.array(F.struct(bound(LEAST, "lo"), bound(GREATEST, "hi"), *none))
    positives = search(pages, slab_boxes, blocks, anchors.withColumn("windows", open_), True, p.positives, s)
    # rounded up and down to whole scores, without doubles
    down = lambda x: f"(({x}) - pmod({x}, 100L)) div 100"
    lo, hi = F.expr(f"-({down(f'({-p.low}) * score')})"), F.expr(down(f"({p.high}) * score"))
    windows = positives.select("row", F.col("rank").alias("w"), F.struct(lo.alias("lo"), hi.alias("hi"), *none).alias("x"))
    asked = windows.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda e: e["x"]).alias("windows"))
    negatives = search(pages, slab_boxes, blocks, anchors.join(asked, "row"), False, p.negatives, s)
    own = lambda f: F.when(f["known"], f["id"])
    positive = positives.select("row", (F.col("rank") - 1).cast("int").alias("window"), own(positives).alias("positive_id"), F.col("score").alias("positive_score"))
    negative = negatives.select("row", "window", F.col("rank").cast("int").alias("rank"), own(negatives).alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    return negative.join(positive, ["row", "window"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
