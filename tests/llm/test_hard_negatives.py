"""Hard negatives against every anchor with every row."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from llm import hard_negatives, queries
from llm.hard_negatives import Boxes, Parameters, Shape, Slab, _tiles, mine

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, p=Parameters()):
    """rows: id, label, vector, anchor."""
    rows = [(i, r) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and None not in r[2]]
    key = lambda s, i, r: (-s, r[0] is None, r[0] or 0, i)
    out = []
    for i, a in rows:
        if a[0] is None or not a[3]:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), j, r) for j, r in rows if j != i]
        same = sorted((t for t in scored if t[2][1] == a[1]), key=lambda t: key(*t))[: p.positives]
        for s, _, q in same:
            fit = sorted((t for t in scored if t[2][1] != a[1] and p.low * s <= 100 * t[0] <= p.high * s), key=lambda t: key(*t))[: p.negatives]
            out += [(a[0], q[0], k, t[2][0], s, t[0]) for k, t in enumerate(fit, 1)]
    return Counter(out)


def hold(spark, rows, p=Parameters()):
    docs = spark.createDataFrame(rows, "id long, label long, vector array<long>, anchor boolean").repartition(3)
    got = Counter(map(tuple, mine(docs, p).collect()))
    assert got == brute(rows, p)
    return sum(got.values())


SMALL = Parameters(rows_per_page=4, rows_per_slab=16, boxes_per_block=3)


def test_many_pages_slabs_and_blocks(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1] * 4 + [2, 3, -5]), [r.randrange(-20, 100) for _ in range(4)], i % 5 == 0) for i in range(300)]
    assert hold(spark, rows, SMALL) > 300
    assert hold(spark, rows, Parameters(positives=1, negatives=50, low=-100, high=100)) > 300


def test_hot_vector_ties_nulls_and_repeated_rows(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 2]), [3, 4] if i % 3 else [r.randrange(9), r.randrange(9)], i % 10 == 0) for i in range(150)]
    rows += [(None, 1, [3, 4], True), (None, 2, [3, 4], False), (None, 2, [2, 3], None), (200, None, [1, 1], True), (210, 1, None, True), (220, 1, [1, None], True), (230, 1, [], True), (240, 1, [5], True), (250, 2, [1, 1, 7], True)]
    rows += [(0, 1, [3, 4], True)] * 3 + [(7, 2, [2, 3], False)] * 30
    assert hold(spark, rows, SMALL) > 100


def test_many_labels_and_large_components(spark):
    r = random.Random(3)
    rows = [(i, i // 2, [r.randrange(1 << 28) for _ in range(3)], i % 7 == 0) for i in range(120)]
    assert hold(spark, rows, SMALL) > 20


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(0, 1, [1, 2], True), (1, 1, [1, 2], False)], "id long, label long, vector array<long>, anchor boolean")
    assert mine(docs).count() == 0 and mine(docs.where("id > 5")).count() == 0 and mine(docs.where("id = 0")).columns == FIELDS


def test_query_against_sql(spark, smallest):
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, smallest).select(*FIELDS).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{smallest}/embeddings.parquet'")
    assert got == sorted(con.execute(f"select {', '.join(FIELDS)} from ({queries.oracle_sql()['op13_hard_negatives']})").fetchall()) and len(got) > 50


def test_what_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, 9, [0.5, -0.001]), (14, 3, [1.0, nan]), (1, 3, [1.0, inf]), (2, None, [1.0, 2.0]), (3, 3, None), (4, 3, [1.0, None]), (50, 3, [-0.25, 1.0]), (None, 3, [0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, vector string")
    got = sorted(map(tuple, queries.labelled_vectors(docs).collect()), key=str)
    assert got == sorted([(7, 0, [128, -1], False), (50, 3, [-64, 256], True), (None, 3, [0, 0], None)], key=str)


@pytest.mark.parametrize("rows", [1, 5, 64, 1000])
def test_tiles(rows):
    v = np.random.default_rng(1).integers(-50, 50, (rows, 5)).astype(np.int16)
    pages = list(_tiles(np.arange(rows), v, (3, 0, 1), 8))
    assert sorted(np.concatenate(pages)) == list(range(rows)) and max(map(len, pages)) <= 8 and len(pages) <= 2 * -(-rows // 8)


def test_bounds_and_pruning():
    """Bounds hold every score, and with clusters apart the queue ends before most pages are opened."""
    rng = np.random.default_rng(2)
    v = (rng.integers(-500, 500, (40, 3))[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 3))).astype(np.int16)
    s = Shape(3, (0, 1, 2), "int16", "float64", 4000)
    pages, start, held = list(_tiles(np.arange(4000), v, s.order, 16)), 0, []
    for at in pages:
        held.append({"slab": 0, "start": start, "label_lo": 1, "label_hi": 1, "id_lo": int(at.min()), "lo": v[at].min(0).tobytes(), "hi": v[at].max(0).tobytes(), "labels": np.ones(len(at), np.int64).tobytes(), "ids": at.astype(np.int64).tobytes(), "known": np.ones(len(at), bool).tobytes(), "vectors": v[at].tobytes()})
        start += len(at)
    slab = Slab(held, s)
    asks = rng.integers(-500, 500, (20, 3)).astype(float)
    least, greatest = slab.boxes.bounds(asks)
    scores = asks @ v.T
    for i, at in enumerate(pages):
        assert (least[:, i] <= scores[:, at].min(1)).all() and (greatest[:, i] >= scores[:, at].max(1)).all()
    opened = []
    class Counted(np.ndarray):
        def __getitem__(self, at):
            opened.append(len(at))
            return np.asarray(super().__getitem__(at))
    slab.vectors = slab.vectors.view(Counted)
    window = np.array([[hard_negatives.LEAST, hard_negatives.GREATEST, hard_negatives.LEAST, hard_negatives.GREATEST]])
    for i in range(20):
        best = slab.search(-1, 1, asks[i], window, least[i], greatest[i], True, 5)[0]
        assert [-x for x, *_ in best] == sorted(scores[i], reverse=True)[:5]
    assert sum(opened) < 20 * 4000 / 5
    assert Boxes(np.zeros((2, 3)), np.ones((2, 3)), np.array([1, 1]), np.array([1, 4]), "float64").fit(1, False).tolist() == [False, True]
