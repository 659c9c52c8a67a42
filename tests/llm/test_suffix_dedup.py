"""Repeated bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from llm import queries
from llm.suffix_dedup import difference_cover, remove_repeats, repeated_bytes

LENGTH = 40


def covered(units, seen, length):
    gone = np.zeros(len(units) + 1, bool)
    for i in range(len(units) - length + 1):
        if seen[units[i : i + length]] > 1:
            gone[i : i + length] = True
    return gone[:-1]


def spans(gone):
    return int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0


def brute(texts, length, words=51):
    """n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    split = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    runs = Counter(w[i : i + words] for w in split for i in range(len(w) - words + 1))
    out = []
    for t, w in zip(texts, split):
        gone, passages = covered(t, seen, length), covered(w, runs, words)
        out.append((len(t), int(gone.sum()), spans(gone), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest(), int(passages.sum()), spans(passages)))
    return out


def hold(docs, rows, length, words=51):
    want = sorted(((k, *b) for (k, *_), b in zip(rows, brute([(r[1] or "").encode() for r in rows], length, words))), key=str)
    assert sorted(map(tuple, repeated_bytes(docs, length, words).collect()), key=str) == want
    return want


def made(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij é\n") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(80):
        text = "".join(r.choice("abcdefgh é\n") for _ in range(r.randrange(0, 90)))
        for _ in range(r.randrange(0, 4)):
            a, n = r.randrange(0, 280), r.choice([30, 38, 39, 40, 41, 42, 50, 80, 200])
            text += r.choice(base)[a : a + n] + "".join(r.choice("abcdefgh\n") for _ in range(r.randrange(0, 50)))
        rows.append((i if i % 17 else 5, text if i % 23 else None))
    return [*rows, (300, "a" * 200), (301, base[0]), (301, base[0]), (302, base[0][:100] + "x" + base[0][101:]), (None, ""), (303, "x" * 39)]


@pytest.mark.parametrize("q", [2, 3, 5, 17])
def test_cover_has_every_difference(q):
    d, v = difference_cover(q), q * q + q + 1
    assert len(d) == q + 1 and {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))


def test_made_texts(spark):
    rows = made(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sum(r[5] for r in hold(docs, rows, LENGTH, 16)) > 100


def test_given_texts(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    want = hold(docs, docs.select("doc_id", "text").collect(), 400)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{smallest}/documents.parquet'")
    assert sorted(con.execute(queries.oracle_sql()["op1_suffix_array_dedup"]).fetchall(), key=str) == want


def test_rows_are_told_apart(spark):
    """Equal ids with other texts, two thousand rows without id, ids past 2 ** 44: each row is judged by its own bytes."""
    r = random.Random(4)
    made = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = made(120)
    rows = [(7, made(60)) for _ in range(300)] + [(None, made(45)) for _ in range(2000)] + [((1 << 44) + i, made(50)) for i in range(50)]
    rows += [(7, shared + made(30)), (8, shared), (None, shared[:70]), ((1 << 60) + 1, made(20) + shared[30:])] + [(9, shared[:50])] * 300
    assert sum(x[2] > 0 for x in hold(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, LENGTH, 16)) == 304


def test_words_that_clash_modulo_powers_of_two(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever the base; they are not equal."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, word.translate({97: 98, 98: 97}))]
    hold(spark.createDataFrame(rows, "doc_id long, text string"), rows, 1100)
    hold(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"), [(i, " ".join(t)) for i, t in rows], 1100, 1100)


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([(1, "abc" * 30, "x", 90), (2, "unique text", None, 11), (3, "abc" * 30, "y", 90), (4, None, "z", None)], "doc_id long, text string, doc string, n_chars long")
    assert repeated_bytes(docs.where("doc_id < 0"), LENGTH).count() == 0
    got = remove_repeats(docs, LENGTH)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(2, "unique text", None, 11), (4, None, "z", None)]
