"""Packing of tokenised documents into sequences under several limits at once (vector bin packing).

A sequence has limits on tokens, segments and loss-bearing tokens.  Pieces are placed by the dot-product heuristic, a sequence at a
time: of the pieces that fit whole, the one whose demands point most in the direction of the room that is left comes next, by the dot
product of the two unit vectors, in tenths; of equally good ones the largest.  Each dimension is a share of its limit, weighted by what
all pieces ask of it, so that a limit that does not bind has no say.  So prompts without loss meet answers full of it, and short
pieces what has few segments.  What room is then left is filled by cutting: the emptiest sequences are dissolved and their pieces
cut into the gaps of the others; the better the placement, the fewer the cuts.  Whatever cannot fill a sequence is carried to the next
batch of the partition; the last of a partition is cut at powers of two, so that no padding is left unless the limits on segments or
loss-bearing tokens bind.

Rows are packed where they are read: no shuffle, memory bounded by one batch, and a lost task is simply run again.  A sequence's id
holds the partition in its high bits.  A partition leaves some sequences shorter than `max_tokens` (each a power of two long).

Defined results: null or empty text is one token, the end.  Repeated rows are packed once each; a row without doc_id has a null one in
its pieces.  A text of any length is cut into pieces of `max_tokens` and a rest.  Pieces of equal demands are placed in the order of
their rows.  Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import Encoder
from llm.common import importable, lean


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Piece:
    row: int
    start: int
    length: int
    #: Loss-bearing tokens are those from here on, counted within the document.
    loss_from: int = 0

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, n, self.loss_from), Piece(self.row, self.start + n, self.length - n, self.loss_from)


class Sequence:
    def __init__(self, limits: Limits):
        self.pieces: list[Piece] = []
        self.room = np.array([limits.tokens, limits.segments, limits.loss], np.int64)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.room -= (piece.length, 1, piece.loss)


def fits(piece: Piece, room: np.ndarray) -> int:
    """How many of the piece's first tokens there is room for."""
    if room[1] < 1:
        return 0
    n = min(piece.length, int(room[0]))
    free = max(0, piece.loss_from - piece.start)
    return n if n <= free else min(n, free + int(room[2]))


def place(pieces: list[Piece], limits: Limits) -> list[Sequence]:
    """Whole pieces into sequences by the dot product of demand and room.  Pieces of equal demands are one kind, so that the work of a
    placement is that of the kinds that are left, however many short pieces there are."""
    if not pieces:
        return []
    full = np.array([limits.tokens, limits.segments, limits.loss], float)
    pieces = sorted(pieces, key=lambda p: (-p.length, p.row, p.start))
    need, kind = np.unique([(-p.length, 1, p.loss) for p in pieces], axis=0, return_inverse=True)
    need[:, 0] *= -1  # the largest first
    stock: list[list[Piece]] = [[] for _ in need]
    for piece, k in zip(reversed(pieces), reversed(kind.ravel().tolist())):
        stock[k].append(piece)
    weight = (need / full * np.bincount(kind.ravel())[:, None]).sum(0)
    weight /= weight.max() * full
    way = need * weight
    way /= np.sqrt((way * way).sum(1))[:, None]
    out, left = [], np.arange(len(need))
    while len(left):
        own = Sequence(limits)
        able = left
        while len(able := able[(need[able] <= own.room).all(1)]):
            room = own.room * weight
            match = np.round(way[able] @ (room / np.sqrt(room @ room)), 1)
            k = int(able[match.argmax()])
            own.add(stock[k].pop())
            if not stock[k]:
                left, able = left[left != k], able[able != k]
        out.append(own)
    return out


def fill(sequences: list[Sequence], limits: Limits) -> tuple[list[Sequence], list[Piece]]:
    """Cuts the pieces of the emptiest sequences into the room of the others; (full ones, pieces left over)."""
    order = sorted(sequences, key=lambda s: int(s.room[0]))
    full = [s for s in order if s.room[0] == 0]
    gaps = order[len(full) :]
    stock: list[Piece] = []
    first, last = 0, len(gaps)
    while first < last:
        gap = gaps[first]
        while gap.room[0] > 0:
            if not stock:
                if last - 1 <= first:
                    break
                last -= 1
                stock = sorted(gaps[last].pieces, key=lambda p: p.length)
            n = fits(stock[-1], gap.room)
            if not n:
                break
            piece = stock.pop()
            if n < piece.length:
                piece, rest = piece.cut(n)
                stock.append(rest)
            gap.add(piece)
        if gap.room[0] > 0 and not (gap.room[1] < 1 or gap.room[2] < 1):
            return full, gap.pieces + stock
        full.append(gap)
        first += 1
    return full, stock


def powers_of_two(pieces: list[Piece], limits: Limits) -> list[Sequence]:
    """The last pieces of a partition: sequences of the largest powers of two that there are tokens for."""
    out, stock = [], list(reversed(pieces))
    left = sum(p.length for p in stock)
    while left:
        size = min(1 << (left.bit_length() - 1), limits.tokens)
        own = Sequence(limits)
        own.room[0] = size
        while own.room[0] > 0 and (n := fits(stock[-1], own.room)):
            piece = stock.pop()
            if n < piece.length:
                piece, rest = piece.cut(n)
                stock.append(rest)
            own.add(piece)
        left -= size - int(own.room[0])
        out.append(own)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), loss_from: str | None = None) -> DataFrame:
    """One row per piece.  tokenizer: a tokenizers JSON file.  loss_from: a column with the number of a document's first
    tokens that bear no loss (a prompt's), none if null."""
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.cached(tokenizer)
        number, carried = TaskContext.get().partitionId() << 32, []
        ids_of: dict[int, tuple[int | None, np.ndarray]] = {}
        row = 0

        def emit(sequences: list[Sequence]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for s in sequences:
                offset = 0
                for p in s.pieces:
                    doc, ids = ids_of[p.row]
                    out.append((doc, p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes()), len(ids), number, offset))
                    offset += p.length
                number += 1
            columns = list(zip(*out)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            docs, free = batch.column("doc_id"), batch.column("loss_from").fill_null(0)
            for first, ids, cuts in encoder.batches(batch, "text"):
                pieces, carried = carried, []
                for i in range(len(cuts) - 1):
                    own = np.append(ids[cuts[i] : cuts[i + 1]], end_id).astype("<u4")
                    ids_of[row] = (docs[first + i].as_py(), own)
                    rest = Piece(row, 0, len(own), free[first + i].as_py())
                    while rest.length > limits.tokens:
                        piece, rest = rest.cut(limits.tokens)
                        pieces.append(piece)
                    pieces.append(rest)
                    row += 1
                full, carried = fill(place(pieces, limits), limits)
                yield emit(full)
                still = {p.row for p in carried}
                ids_of = {k: x for k, x in ids_of.items() if k in still}
        yield emit(powers_of_two(carried, limits))

    free = F.lit(0) if loss_from is None else F.col(loss_from).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", free.cast("long").alias("loss_from")).mapInArrow(lean(run, "encoders"), SCHEMA)
