"""Byte-level BPE: encoding by a finite-state transducer that is determinised as it runs, and streaming decoding.

Text is split at the pattern's matches, column-wise in numpy.  Each distinct match of a batch is encoded once, and remembered in a
table of bounded size (looked up by hash, taken only if the bytes are equal); what the table lacks goes through the transducer (`Transducer`) byte by byte.  A state of the transducer
is what the future can depend on: the last bytes that may still begin a token, and for each place within them the tokens that would
be pending if the next token began there.  Tokens that all these agree on are emitted; so a token leaves as soon as no
continuation can change it, at most a token's length later.  Transitions are computed when first taken.

Why one pass will do: the tokens of a prefix end in exactly one token t such that the tokens before it are those of the prefix
without t, and t may follow the token before it (no merge crosses between them before both are complete).

Defined results: null or empty text has no tokens and decodes to no bytes; text is never normalised; repeated rows are encoded each; a
null doc_id stays null; a text of any length, and a match of any length, is encoded whole; columns other than doc_id and text are
ignored; an empty table gives an empty one.  Special tokens are ordinary text to `encode_documents`.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import KEPT, SpanHash, gather, importable, lean, text_slices

LETTER, NUMBER, BLANK, OTHER = range(4)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of each code point, as the pattern tells them apart."""
    if not _kinds:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            table[[ord(c) for c in regex.findall(pattern, every)]] = kind
        _kinds.append(table)
    return _kinds[0]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each code point, the code points) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    points = buf[at].astype(np.int32)
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = np.flatnonzero((points >= low) & (points < (low | mask) + 1) & (buf[at] >= low))
        value = points[some] & mask
        for i in range(1, size):
            value = value << 6 | (buf[np.minimum(at[some] + i, len(buf) - 1)] & 0x3F)
        points[some] = value
    return at, points


def split(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of each match of the pattern; matches tile the rows.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks but for the last before a non-blank|blanks."""
    if not len(buf):
        return np.zeros(0, np.int64)
    at, points = code_points(buf)
    kind = kinds()[points]
    n = len(at)
    head = np.zeros(n, bool)
    head[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(buf)])] = True
    new = head.copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    of = kind[start]
    begins = np.zeros(n + 1, bool)
    begins[start] = True
    follows = np.append(~head[start[1:]], False)  # another run of the same row comes next
    blank = of == BLANK
    begins[end[blank & follows] - 1] = True
    joined = np.zeros(len(start), bool)
    joined[1:] = blank[:-1] & follows[:-1] & ~blank[1:] & (points[end[:-1] - 1] == 0x20)
    begins[start[joined]] = False
    lone = np.flatnonzero((of[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (points[start[:-1]] == 0x27) & ~joined[:-1] & follows[:-1] & (of[1:] == LETTER)) if len(start) > 1 else np.zeros(0, np.int64)
    if len(lone):
        first = start[lone + 1]
        size = end[lone + 1] - first
        a, b = points[first], points[np.minimum(first + 1, n - 1)]
        two = (size > 1) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        take = np.where(two, 2, np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0))
        begins[first[take > 0]] = False
        rest = (take > 0) & (take < size)
        begins[first[rest] + take[rest]] = True
    return at[np.flatnonzero(begins[:n])]


class Encoder:
    """Ids of whole columns of text; subclasses encode single matches."""

    _cache: ClassVar[dict] = {}
    #: Distinct matches remembered at most; then the table starts again from those of the batch.
    remembered = 1_500_000

    @classmethod
    def cached(cls, path: str) -> Encoder:
        """One per Python worker and file."""
        if path not in Encoder._cache:
            Encoder._cache[path] = FileEncoder(path) if path.endswith(".json") else RankEncoder(path)
        return Encoder._cache[path]

    def __init__(self):
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.text_begin, self.text_size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def encode_matches(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def forget(self, kept: np.ndarray) -> None:
        """Only these places of the table stay."""
        self.flat, self.text = gather(self.flat, self.begin[kept], self.size[kept]), gather(self.text, self.text_begin[kept], self.text_size[kept])
        self.keys, self.size, self.text_size = self.keys[kept], self.size[kept], self.text_size[kept]
        self.begin, self.text_begin = np.cumsum(self.size) - self.size, np.cumsum(self.text_size) - self.text_size

    def look_up(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """The place in the table of each of the distinct matches; None if one has the hash, but not the bytes, of what is there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        old, new = at[known], np.flatnonzero(~known)
        same_size = np.array_equal(self.text_size[old], (ends - starts)[known])
        if not same_size or not np.array_equal(gather(self.text, self.text_begin[old], self.text_size[old]), gather(buf, starts[known], self.text_size[old])):
            return None
        if not len(new):
            return at
        data = buf.tobytes()
        ids = self.encode_matches([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        if len(self.keys) + len(new) > self.remembered:
            self.forget(np.unique(old))
        size, text_size = np.fromiter(map(len, ids), np.int64, len(ids)), (ends - starts)[new]
        keys_all = np.concatenate([self.keys, keys[new]])
        order = np.argsort(keys_all)
        self.keys = keys_all[order]
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])[order]
        self.text_begin = np.concatenate([self.text_begin, len(self.text) + np.cumsum(text_size) - text_size])[order]
        self.size, self.text_size = np.concatenate([self.size, size])[order], np.concatenate([self.text_size, text_size])[order]
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        self.text = np.concatenate([self.text, gather(buf, starts[new], text_size)])
        return np.searchsorted(self.keys, keys)

    def encode_all(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the matches, how many each has)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, index, of = np.unique(SpanHash(buf)(starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[index][of]
        if np.array_equal(size, ends - starts) and np.array_equal(gather(buf, starts[index][of], size), buf):
            at = self.look_up(keys, buf, starts[index], ends[index])
            if at is not None:
                return gather(self.flat, self.begin[at[of]], self.size[at[of]]), self.size[at[of]]
        data = buf.tobytes()  # two matches share a hash: by their bytes, without the table
        matches = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        distinct = list(dict.fromkeys(matches))
        ids_of = dict(zip(distinct, self.encode_matches(distinct)))
        ids = [ids_of[m] for m in matches]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def slices(self, batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first, _, buf, offsets in text_slices(batch, name, 2 << 20):
            starts = split(buf, offsets)
            ids, size = self.encode_all(buf, starts, np.append(starts[1:], len(buf)) if len(starts) else starts)
            # ids before each match, and so before each row
            yield first, ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]

    def batches(self, batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each row's ids begin, with the end of the last) of slices of a batch."""
        return self.slices(batch, name)


KEPT["encoders"] = Encoder._cache


class FileEncoder(Encoder):
    """By a tokenizers JSON file, with the library's own results: special tokens in a text are found as it finds them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        probe = [("ab", (0, 2)), ("Ġcd", (2, 5))]
        #: Only such tokenizers encode each match by itself; others take whole texts.
        self.by_match = self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and before.pre_tokenize_str("ab cd") == probe
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_matches(self, words: list[bytes]) -> list[list[int]]:
        texts, each = [w.decode("utf-8", "replace") for w in words], self.tokenizer.encode_batch  # what it returns is large: some at a time
        return [x.ids for i in range(0, len(texts), 4096) for x in each(texts[i : i + 4096], add_special_tokens=False)]

    def batches(self, batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        column = batch.column(name)
        data = column.buffers()[-1]
        whole = data.to_pybytes() if self.by_match and data is not None else b""
        marked = any(s in whole for s in self.special)
        for first, ids, cuts in self.slices(batch, name) if self.by_match else self.whole(batch, name):
            if marked:
                for i, text in enumerate(column.slice(first, len(cuts) - 1).to_pylist()):
                    if text and any(s.decode() in text for s in self.special):
                        new = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                        ids = np.concatenate([ids[: cuts[i]], new, ids[cuts[i + 1] :]])
                        cuts = np.append(cuts[: i + 1], cuts[i + 1 :] + (len(new) - (cuts[i + 1] - cuts[i])))
            yield first, ids, cuts

    def whole(self, batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first in range(0, batch.num_rows, 256):
            texts = [t or "" for t in batch.column(name).slice(first, 256).to_pylist()]
            ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            yield first, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


class Transducer:
    """A lazily determinised transducer from bytes to tokens, compiled from ranks."""

    most_states = 250_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.prefixes = {b[:i] for b in ranks for i in range(1, len(b) + 1)}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[bytes, tuple[tuple[int, ...], ...], int | None]] = [(b"", ((),), None)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def parts(self, token: bytes) -> list[bytes]:
        """The two parts whose merge makes the token: what merging its bytes by lower ranks leaves."""
        limit, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if rank >= limit:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """What stands at the token's right (left) edge while it is being made, each with the rank of the merge that ends it."""
        if (token, right) not in self.spines:
            out, now, ends = [], self.bytes_of[token], float("inf")
            while True:
                out.append((now, ends))
                if len(now) == 1:
                    break
                ends, now = self.ranks[now], self.parts(now)[-1 if right else 0]
            self.spines[token, right] = out
        return self.spines[token, right]

    def may_follow(self, a: int, b: int) -> bool:
        """No merge crosses the boundary of tokens a and b.  Of equal ranks the leftmost merge comes first."""
        if (a, b) not in self.follows:
            if len(self.follows) > 3 * self.most_states:
                self.follows.clear()
            get = self.ranks.get
            left = self.spine(b, False)
            for x, x_ends in self.spine(a, True):
                for y, y_ends in left:
                    if (r := get(x + y)) is not None and r < x_ends and r <= y_ends:
                        self.follows[a, b] = False
                        return False
            self.follows[a, b] = True
        return self.follows[a, b]

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and what is emitted; computed once for each state and byte."""
        tail, pending, before = self.states[state]
        tail += bytes((byte,))
        get, prefixes, size = self.ranks.get, self.prefixes, len(tail)
        for k in range(size):
            token = get(tail[k:])
            if token is not None:
                last = pending[k][-1] if pending[k] else before
                if last is None or self.may_follow(last, token):
                    grown = (*pending[k], token)
                    break
        cut = 0
        while cut < size and tail[cut:] not in prefixes:
            cut += 1
        pending, same = (*pending[cut:], grown), 0
        for column in zip(*pending):
            if column.count(column[0]) < len(column):
                break
            same += 1
        out = pending[0][:same]
        new = (tail[cut:], tuple([p[same:] for p in pending]) if same else pending, out[-1] if out else before)
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        self.moves[state << 8 | byte] = step = (self.number[new], out)
        return step

    def encode(self, match: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self.reset()
        state, out, get = 0, [], self.moves.get
        for byte in match:
            step = get(state << 8 | byte) or self.move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        out += self.states[state][1][-1]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@contextmanager
def no_collection() -> Iterator[None]:
    """The transducer's tables have no cycles: the collector, which would walk them again and again as they grow, rests meanwhile, and
    passes over them later."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        if before:
            gc.enable()


class RankEncoder(Encoder):
    """By a file of ranks, through the transducer."""

    def __init__(self, path: str):
        super().__init__()
        self.transducer = Transducer(read_ranks(path))
        tokens = [self.transducer.bytes_of.get(i, b"") for i in range(max(self.transducer.bytes_of) + 1)]
        self.token_size = np.array([len(t) for t in tokens])
        self.token_begin = np.cumsum(self.token_size) - self.token_size
        self.token_flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(i) for i in range(len(tokens))]

    def encode_matches(self, words: list[bytes]) -> list[list[int]]:
        encode = self.transducer.encode
        with no_collection():
            return [encode(w) for w in words]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_flat, self.token_begin[ids], self.token_size[ids]).tobytes()


class Utf8Stream:
    """Decodes bytes as they come: whole code points leave, what a chunk cuts off waits for the next.  The state machine walks only
    over a chunk's last code point; bytes that can begin or continue nothing become U+FFFD."""

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many of the last bytes are the beginning of a code point that goes on."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 1
                if need <= back:
                    return 0
                second = data[-back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                return 0 if second is not None and not low <= second <= high else back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        n = self.unfinished(data)
        self.waiting = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        last, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return last


def decode_stream(encoder: RankEncoder, chunks: Iterable[np.ndarray]) -> Iterator[str]:
    """Text as ids come in."""
    stream = Utf8Stream()
    for ids in chunks:
        yield stream.feed(encoder.decode(ids))
    yield stream.end()


def encode_documents(documents: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids."""
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.cached(ranks)
        for batch in batches:
            for first, ids, cuts in encoder.batches(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(cuts) - 1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run, "encoders"), "doc_id long, ids array<int>")


def round_trip(documents: DataFrame, ranks: str, chunk: int = 4096) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids are decoded as a stream of chunks."""
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.cached(ranks)
        for batch in batches:
            for first, ids, cuts in encoder.batches(batch, "text"):
                names, of_ids, of_text = list(map(encoder.decimal.__getitem__, ids.tolist())), [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    of_ids.append(hashlib.sha256(" ".join(names[a:b]).encode()).hexdigest())
                    sha = hashlib.sha256()
                    for part in decode_stream(encoder, (ids[i : min(i + chunk, b)] for i in range(a, b, chunk))):
                        sha.update(part.encode())
                    of_text.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(cuts) - 1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run, "encoders"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
