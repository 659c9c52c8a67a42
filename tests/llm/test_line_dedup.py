"""Aligned lines against a plain version."""

import hashlib
import random
from collections import Counter

from llm.line_dedup import Parameters, deleted_lines, longest_run, remove_lines


def matched(a, b):
    """Patience alignment by its definition: ends, then a longest chain of lines that are single on both sides (quadratic), then gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in matched(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*matched(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not once:
        return []
    best = [(1, -1)] * len(once)
    for i, (_, y) in enumerate(once):
        best[i] = max([(1, -1), *((best[k][0] + 1, k) for k in range(i) if once[k][1] < y)], key=lambda t: t[0])
    length = max(n for n, _ in best)
    kept = [once[i] for i in longest_run([y for _, y in once])]
    assert len(kept) == length and all(x[1] < y[1] for x, y in zip(kept, kept[1:]))
    out, i, j = [], 0, 0
    for x, y in [*kept, (len(a), len(b))]:
        out += [(i + u, j + v) for u, v in matched(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def order(row):
    return (row[0] is not None, row[0] or 0)


def shares(a, b, sizes, least):
    """Whether two lists of lines have a stretch of `least` bytes in common, by the longest common stretch that ends at each pair of places."""
    before = {}
    for i, x in enumerate(a):
        now = {}
        for j, y in enumerate(b):
            if x == y:
                now[j] = before.get(j - 1, 0) + sizes[i]
                if now[j] >= least:
                    return True
        before = now
    return False


def brute(rows, p=Parameters(), again=True):
    """For each distinct row, the places of the lines that go: every pair of documents that has 40 bytes of lines in common is aligned;
    again: what is left is aligned again till nothing goes."""
    rows = sorted(dict.fromkeys(rows), key=order)
    lines = [(t or "").split("\n") for _, t in rows]
    sizes = [[len(x.encode()) for x in v] for v in lines]
    sets, gone = [set(v) for v in lines], [set() for _ in rows]
    for d in range(len(rows)):
        for e in range(d):
            found = not sets[d].isdisjoint(sets[e]) and shares(lines[d], lines[e], sizes[d], p.min_block_bytes)
            own = list(lines[d])
            while found:
                found, block = False, []
                for i, j in [*matched(own, lines[e]), (-1, -1)]:
                    if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                        if sum(sizes[d][k] for k, _ in block) >= p.min_block_bytes:
                            gone[d] |= {k for k, _ in block}
                            for k, _ in block:
                                own[k], found = f"gone {k}\n", again
                        block = []
                    block.append((i, j))
    return {r: (v, g) for r, v, g in zip(rows, lines, gone)}


def digest(lines, gone):
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return len(lines), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def hold(docs, p=Parameters()):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, p)
    assert Counter(map(tuple, deleted_lines(docs, p).collect())) == Counter((r[0], *digest(*want[r])) for r in rows)
    return sum(len(g) for _, g in want.values())


def test_given_texts(spark, smallest):
    assert hold(spark.read.parquet(f"{smallest}/documents.parquet")) > 50


def test_against_one_pass_over_all_pairs(spark, smallest):
    """Plain patience diff of every pair of documents, in one pass each, deletes the same lines of the given texts."""
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, got = brute(rows, again=False), {r.doc_id: r.n_deleted for r in deleted_lines(docs).collect()}
    n = sum(len(g) for _, g in want.values())
    assert n > 50 and all(got[r[0]] >= len(g) for r, (_, g) in want.items()) and sum(got.values()) <= 1.02 * n


def pool_rows(r, n, pool):
    return [(i if i % 11 else None, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 12))) if i % 13 else None) for i in range(n)]


def test_made_texts(spark):
    """With all holders of every line paired the result is that of all pairs."""
    r = random.Random(2)
    pool = [f"line {i} of the pool, long enough for an anchor {i * i}" for i in range(40)] + ["short", "", "a line of twenty byte"]
    rows = pool_rows(r, 150, pool)
    rows = [(k, t if k is not None else f"{t}\n{i}") for i, (k, t) in enumerate(rows) if k is not None or i == 0]
    assert hold(spark.createDataFrame([*rows, rows[20], rows[20]], "doc_id long, text string").repartition(3), Parameters(rare=1000)) > 100


def test_frequent_lines_in_shared_order(spark):
    """Runs of one long text, with own lines between: every line is frequent, and what windows pair is what all pairs would give."""
    r = random.Random(3)
    text = [f"{i} of the text" + " and more" * r.randrange(0, 5) for i in range(60)] + ["", "x"]
    rows = []
    for k in range(120):
        out = []
        for a in sorted(r.sample(range(50), 2)):
            out += [f"own {k} {a} {r.random()}", *text[a : a + r.randrange(1, 9)]]
        rows.append((k, "\n".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, got = brute(rows), {x.doc_id: x.n_deleted for x in deleted_lines(docs).collect()}
    n = sum(len(g) for _, g in want.values())
    # lines that a document repeats are aligned with some holders and not with others; the rest is equal
    assert n > 200 and 0.98 * n <= sum(got.values()) <= n and all(got[k] <= len(g) for (k, _), (_, g) in want.items())


def test_order_and_blocks_of_many_partners(spark):
    a, b, own = "first line of thirty bytes ...", "second line of thirty bytes ..", "a line that no other document has {}"
    rows = [(1, f"{a}\n{own.format(1)}"), (2, f"{b}\n{own.format(2)}"), (3, f"{a}\n{b}"), (4, f"{a}\n{b}")]
    rows += [(1 << 43, f"{a}\n{b}\nx"), ((1 << 62) + 1, f"{own.format(1)} is longer now"), ((1 << 62) + 2, f"{own.format(1)} is longer now"), (None, f"{own.format(1)} is longer now")]
    for p in (Parameters(), Parameters(rare=1)):
        got = {r.doc_id: r.n_deleted for r in deleted_lines(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
        assert got == {1: 0, 2: 0, 3: 0, 4: 2, 1 << 43: 2, (1 << 62) + 1: 1, (1 << 62) + 2: 1, None: 0}


def test_short_and_repeated_lines_between_anchors(spark):
    """Gaps between anchors are aligned too, and what blocks grow by counts."""
    one, two = "an anchor of more than forty bytes, number one", "an anchor of more than forty bytes, number two"
    rows = [(1, f"{one}\nshort a\nshort b\n\nx\n{two}\nend"), (2, f"{one}\nshort a\nshort b\n\ny\n{two}\nend\nmore"), (3, "tail\ntail\na line of twenty bytes\nshort\nand shorter"), (4, "head\ntail\na line of twenty bytes\nshort\nand shorter")]
    got = {r.doc_id: (r.n_deleted, r.n_blocks) for r in deleted_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (6, 2), 3: (0, 0), 4: (4, 1)}
    assert hold(spark.createDataFrame(rows, "doc_id long, text string")) == 10


def test_short_lines_only(spark):
    """A copied block of short lines, and one whose lines repeat, have no line of their own to go by."""
    short = [f"item {i}" for i in range(40)]
    rows = [(1, "\n".join(["first", *short, "end of one"])), (2, "\n".join(["second", *short, "end of two"]))]
    rows += [(3, "\n".join(["-", "=" * 15] * 5)), (4, "\n".join(["own line", *["-", "=" * 15] * 5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_deleted for r in deleted_lines(docs).collect()}
    assert got == {1: 0, 2: 40, 3: 0, 4: 10}
    assert hold(docs) == 50


def test_partners_of_a_document_in_several_tasks(spark):
    """A late document made of pieces of many earlier ones."""
    pieces = [f"piece {i} of the collection, of more than forty bytes in all" for i in range(60)]
    rows = [(i, f"{x}\nown line {i}") for i, x in enumerate(pieces)] + [(100, "\n".join(["start", *pieces, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for p in (Parameters(), Parameters(partners_per_task=7)):
        assert {r.doc_id: r.n_deleted for r in deleted_lines(docs, p).where("n_deleted > 0").collect()} == {100: 60}


def test_stage(spark):
    line = "this line is in two documents and has more than forty bytes"
    rows = [(1, f"{line}\nown one", "a", 9), (2, f"own two\n{line}", "b", 9), (3, line, "c", 9), (4, None, "d", None), (5, "", "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, n_chars long")
    got = sorted(map(tuple, remove_lines(docs).collect()))
    assert got == [(1, f"{line}\nown one", "a", len(line) + 8), (2, "own two", "b", 7), (4, None, "d", None), (5, "", "e", 0)] or got[0][3] == 9
    assert remove_lines(docs).columns == docs.columns and remove_lines(docs.where("doc_id < 0")).count() == 0
