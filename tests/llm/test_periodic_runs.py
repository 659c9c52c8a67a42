"""Runs against every lag of every text."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from llm import queries
from llm.common import read
from llm.periodic_runs import Parameters, find_runs, runs


def brute(x, p=Parameters()):
    """Maximal stretches of every lag; those that a smaller one explains go."""
    n, out = len(x), []
    for q in range(1, n // p.min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(p.min_length, p.min_exponent * q) and not any(q % g == 0 and all(x[t] == x[t + g] for t in range(i, j + q - g)) for g in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(r, n, letters):
    x = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randrange(4)):
        if n > 10:
            s, q = r.randrange(n), r.randrange(1, 1 + max(1, n // r.randrange(2, 12)))
            for i in range(s + q, min(n, s + q * r.randrange(2, 9) + r.randrange(q))):
                x[i] = x[i - q]
    return x


@pytest.mark.parametrize("short", [1, 4, 16])
def test_sequences(short):
    r, total = random.Random(short), 0
    for _ in range(400):
        x = periodic(r, r.randrange(1, 300), r.choice([1, 2, 3, 30]))
        want = brute(x)
        assert [tuple(v) for v in runs(np.array(x, np.int32), len(x), Parameters(short=short)).tolist()] == want
        total += len(want)
    assert total > 400


def test_words_of_fibonacci_and_thue_morse():
    """Texts full of squares whose factors repeat at many distances."""
    fib, morse = [[0], [0, 1]], [0]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
        morse += [1 - x for x in morse] if len(morse) < 512 else []
    for x in (fib[-1], morse, morse * 5, [0] * 99 + morse[:70] * 6 + [1] * 5):
        assert [tuple(v) for v in runs(np.array(x, np.int32), len(x), Parameters(short=2)).tolist()] == brute(x)


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = edited(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


FIELDS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def made():
    r = random.Random(9)
    gap = lambda: r.choice([" ", "\n", "\t ", "\x0b", "\x1c", " "])
    texts = ["".join(f"w{k}{gap()}" for k in periodic(r, r.randrange(1, 150), r.choice([1, 3, 40]))) for _ in range(120)]
    return [*texts, None, "", " ", "\n\n", "one", "é é é é é é", "a " * 4000, "x" * 200_000, "a b " * 30 + "c d " * 30]


def test_query_on_made_texts(spark, tmp_path):
    rows = [(i if i % 11 else None, t, "clash", 1) for i, t in enumerate(made() * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == FIELDS
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(d, t) for d, t, *_ in rows), key=str)
    assert find_runs(read(spark, str(tmp_path), "documents").where("doc_id < 0")).count() == 0


def test_given_texts_and_sql(spark, smallest):
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, smallest).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{smallest}/documents.parquet'")
    want = con.execute(f"select {', '.join(FIELDS)} from ({queries.oracle_sql()['op12_periodic_runs']})").fetchall()
    assert got == sorted(want, key=str) and sum(r[1] for r in got) > 10


def test_collapsed_texts(spark):
    """The operator's own columns, on texts as they are."""
    docs = spark.createDataFrame([(10, "so so so so so so it goes"), (2, "a b c a b c a b c a b c a end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()}
    assert got == {10: (8, [(0, 6, 1)], "so it goes"), 2: (14, [(0, 13, 3)], "a b c end"), 3: (0, [], "")}
    with pytest.raises(ValueError):
        find_runs(docs, Parameters(min_exponent=3))


def test_a_very_long_text(spark):
    words = [f"w{i % 7001}" for i in range(300_000)]
    docs = spark.createDataFrame([(1, "start " + " ".join(words) + " end"), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in find_runs(docs).select("doc_id", "runs").collect()}
    assert got == {1: [(1, 300_000, 7001)], 2: []}
