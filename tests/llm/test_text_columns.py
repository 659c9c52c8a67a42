"""Columnar helpers."""

import random
import re

import numpy as np
import pyarrow as pa

from llm.common import SpanHash, line_spans, text_slices, word_spans


def some_texts():
    r = random.Random(5)
    made = ["".join(r.choice("ab é\n\t\x0b🙂 ") for _ in range(r.randrange(0, 40))) for _ in range(300)]
    return [*made, "", None, " ", "\n", "x" * 5000, "a b"]


def slices(limit):
    texts = some_texts()
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    return texts, text_slices(batch, "text", limit)


def test_words_and_lines():
    texts, parts = slices(500)
    words, lines = [], []
    for first, last, buf, offsets in parts:
        data = buf.tobytes()
        for spans, out in ((word_spans, words), (line_spans, lines)):
            s, e, row = spans(buf, offsets)
            out += [(first + i, data[a:b]) for a, b, i in zip(s, e, row)]
    plain = [(t or "").encode() for t in texts]
    assert words == [(i, w) for i, t in enumerate(plain) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert lines == [(i, x) for i, t in enumerate(plain) for x in t.split(b"\n")]


def test_equal_spans_have_equal_hashes():
    buf = np.frombuffer(b"abcabcabdabc", np.uint8)
    h = SpanHash(buf)(np.array([0, 3, 6, 9, 0]), np.array([3, 6, 9, 12, 2]))
    assert h[0] == h[1] == h[3] and len({int(x) for x in h}) == 3
