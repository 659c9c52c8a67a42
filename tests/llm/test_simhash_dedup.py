"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import xxhash

from llm.common import materialize
from llm.graph import components
from llm.simhash_dedup import _grouped, ball_links, forest, keep_one, near_groups


def fingerprint(text, width=4):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def groups(fps, radius=4):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius) + k + 1:
            x, y = root(i), root(ids[j])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_given_texts(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    fps = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    own = groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_groups(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", own[i]) for i in fps}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(set(own.values()))


def test_chains_and_clusters(spark):
    r, fps = random.Random(1), {}
    for i in range(1500):
        old = fps[r.randrange(max(0, i - 200), i)] if i else 0
        fps[i] = r.getrandbits(64) if not i or r.random() < 0.1 else old ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 7)))
    fps |= {2000 + i: fps[0] ^ 1 << i % 40 ^ 1 << i % 37 for i in range(400)}
    rows = materialize(spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long"), "test")
    assert dict(rows.join(_grouped(rows, 4), "fp").select("doc_id", "component_id").collect()) == groups(fps)


def test_balls_connect_as_all_pairs_do():
    r = random.Random(4)
    fps = np.unique(np.array([sum(1 << b for b in r.sample(range(20), r.randrange(0, 9))) for _ in range(600)], np.uint64))
    found, all_pairs = forest(ball_links(fps, 2)), groups(dict(enumerate(fps.tolist())), 2)
    mine = groups_of({int(f): found.get(int(f), int(f)) for f in fps})
    assert mine == groups_of({int(fps[i]): all_pairs[i] for i in all_pairs})


def groups_of(root):
    out = {}
    for x, y in root.items():
        out.setdefault(y, set()).add(x)
    return {frozenset(s) for s in out.values()}


def test_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long").repartition(4)
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000} or got == {i: 0 for i in range(n + 1)} | {1001: 1000, 1000: 1000}


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "y"), (2, " \n", "z"), (5, "ONE two three four five", "a"), (4, "one two THREE four five", "b"), (4, "one two THREE four five", "b"), (None, "no id at all here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in near_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (None, None)], key=str)
    assert sorted((r.doc_id or 0, r.fp) for r in keep_one(docs).collect()) == [(0, "c"), (1, "y"), (4, "b")]
    assert near_groups(docs.where("doc_id < 0")).count() == 0 and keep_one(docs.where("doc_id < 0")).count() == 0


def test_large_tables_are_dealt_anew():
    """One key for all: members spread out, clouds of near ones, and both; the components are those of all pairs."""
    import numpy as np

    from llm.common import U64
    from llm.simhash_dedup import finer, forest, table_links

    rng = np.random.default_rng(7)
    low = U64(0xFFFFFFFF)
    spread = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & low
    flips = lambda centre, n, most: np.array([int(centre) ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(0, most + 1), replace=False)) for _ in range(n)], np.uint64)
    cloud = flips(spread[0], 1500, 6)
    few = flips(0, 700, 3) & U64(0x7)
    for fps in (spread, cloud, np.concatenate([spread, cloud]), few, spread[:2], np.concatenate([cloud, flips(spread[1], 400, 9)])):
        fps = np.unique(fps)
        got = forest(table_links(np.zeros(len(fps), np.uint64), fps, 4))
        near = np.bitwise_count(fps[:, None] ^ fps) <= 4
        label = np.arange(len(fps))
        while True:
            new = np.array([label[n].min() for n in near])
            if (new == label).all():
                break
            label = new
        want = {int(f): int(fps[k]) for f, k in zip(fps, label)}
        assert {k: got.get(k, k) for k in want} == want
    keys, members = finer(np.unique(spread), 4)
    assert len(members) == 15 * len(np.unique(spread)) and np.bincount(np.unique(keys, return_inverse=True)[1]).max() < 60
