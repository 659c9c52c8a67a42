"""The transducer against the library, and decoding by any chunks."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import bpe
from llm.bpe import Encoder, Transducer, Utf8Stream, decode_stream, encode_documents, read_ranks, round_trip

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def texts():
    r = random.Random(3)
    alphabet = list("'stmdrevl lL  \n\t\r9x١é中🙂!?  \u0085.,-\x1c\x1f²Ⅷ")
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    return [*made, "", None, "a" * 3000, "it's'll 've  're'", " " * 50, "x" + " " * 9, "<|endoftext|> hi", "aaaaaaab" * 300]


@pytest.mark.parametrize("path", [RANKS, JSON])
def test_encoding(path, library):
    encoder, given_texts, got = Encoder.cached(path), texts(), []
    for _, ids, cuts in encoder.batches(pa.RecordBatch.from_pydict({"text": pa.array(given_texts)}), "text"):
        got += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    if path == RANKS:
        want = [library.encode_ordinary(t or "") for t in given_texts]
    else:
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in given_texts]
    assert got == want


@pytest.mark.parametrize("path", [RANKS, JSON])
def test_matches_of_one_hash_are_told_apart(path, library, monkeypatch):
    """Thue-Morse words clash modulo any power of two; and even with a hash that tells nothing apart, ids are those of the bytes."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    given = [word, word.translate({97: 98, 98: 97}), "ab cd ab cd", "cd ab"]
    tokens = Encoder.cached(path).tokenizer.encode if path == JSON else None
    want = [tokens(t, add_special_tokens=False).ids if tokens else library.encode_ordinary(t) for t in given]

    def encoded(encoder, texts):
        out = []
        for _, ids, cuts in encoder.batches(pa.RecordBatch.from_pydict({"text": pa.array(texts)}), "text"):
            out += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    for order in (given, given[::-1]):
        fresh = type(Encoder.cached(path))(path)
        assert encoded(fresh, order) == (want if order is given else want[::-1])
        assert [encoded(fresh, [t])[0] for t in given] == want
    fresh = type(Encoder.cached(path))(path)
    monkeypatch.setattr(bpe.SpanHash, "__call__", lambda self, starts, ends: np.full(len(starts), 7, np.uint64))
    assert encoded(fresh, given) == want and [encoded(fresh, [t])[0] for t in given] == want


def test_other_ranks_and_forgetting(library):
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    machine = Transducer(ranks)
    machine.most_states = 50
    other = tiktoken.Encoding("other", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    for t in texts()[:400]:
        assert machine.encode((t or "").encode()) == other.encode_ordinary(t or "")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 7))
def test_stream_of_any_bytes(data, step):
    stream = Utf8Stream()
    parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
    assert "".join([*parts, stream.end()]) == data.decode("utf-8", "replace")


def test_stream_of_ids(library):
    encoder = Encoder.cached(RANKS)
    text = "中文🙂 é " * 50
    ids = np.array(library.encode_ordinary(text))
    for step in (1, 2, 5):
        assert "".join(decode_stream(encoder, (ids[i : i + step] for i in range(0, len(ids), step)))) == text


def test_documents(spark, smallest, library):
    import hashlib

    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    ids = {r.doc_id: r.ids for r in encode_documents(docs, RANKS).collect()}
    got = {r.doc_id: r for r in round_trip(docs, RANKS, chunk=7).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = library.encode_ordinary(r.text or "")
        assert ids[r.doc_id] == want and got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert round_trip(docs.where("doc_id < 0"), RANKS).count() == 0
    again = spark.createDataFrame([(7, "same text"), (7, "same text"), (None, "same text")], "doc_id long, text string")
    assert len({tuple(r)[1:] for r in round_trip(again, RANKS).collect()}) == 1 and sorted(str(r.doc_id) for r in round_trip(again, RANKS).collect()) == ["7", "7", "None"]
    nothing = spark.createDataFrame([(1, None, "x")], "doc_id long, text string, ids string")
    assert round_trip(nothing, RANKS).first().n_tokens == 0


def test_the_collector_rests_while_the_transducer_runs():
    import gc

    encoder, ran = bpe.RankEncoder.__new__(bpe.RankEncoder), []

    class Probe:
        def encode(self, word: bytes) -> list[int]:
            ran.append(gc.isenabled())
            if word == b"bad":
                raise ValueError(word)
            return [len(word)]

    encoder.transducer = Probe()
    assert gc.isenabled() and encoder.encode_matches([b"a", b"bc"]) == [[1], [2]] and ran == [False, False] and gc.isenabled()
    with pytest.raises(ValueError):
        encoder.encode_matches([b"bad"])
    assert gc.isenabled()
