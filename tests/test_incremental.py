"""What is kept and added to: caches of several writers, ranges rewritten in place, statistics by file, doubling histograms; and the
nearest in an order."""

import math
import os
import random
import shutil
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake import ledger, sinks
from trajlake.operators import asof, histograms
from trajlake.operators import statistics as st
from trajlake.streaming.statistics import keep_statistics, statistics, unreadable


def test_a_file_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/x/000000000.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: ledger.create(spark, path, f"writer {i}" * 1000), range(8)))
    assert sum(made) == 1 and os.listdir(f"{tmp_path}/x") == ["000000000.json"]
    assert open(path).read() == f"writer {made.index(True)}" * 1000


@pytest.mark.parametrize("overlap", [0, 40])
def test_two_writers_at_a_time(spark, tmp_path, overlap):
    """Both look before either has published: the second takes out what the first has, and no key has two rows."""
    path, waiting = f"{tmp_path}/cache", []

    def fill(n):
        def encode(rows):  # the other one publishes after this one has looked, once
            if not waiting:
                waiting.append(n)
                rows_of(50 - overlap, 100 - overlap, "second")
            return rows.withColumn("v", F.lit(f"writer {n}"))

        return encode

    def rows_of(a, b, name):
        keys = spark.range(a, b).select(F.col("id").alias("k"))
        return ledger.put_absent(keys, ["k"], path, lambda rows: rows.withColumn("v", F.lit(name)))

    first = ledger.put_absent(spark.range(0, 50).select(F.col("id").alias("k")), ["k"], path, fill(1))
    got = [(r.k, r.v) for r in ledger.published(spark, path).collect()]
    assert sorted(k for k, _ in got) == list(range(100 - overlap)) and first == 50 - overlap
    assert {v for k, v in got if k >= 50 - overlap} == {"second"} and len(ledger.entries(spark, path)) == 2


def test_many_writers_in_threads(spark, tmp_path):
    path = f"{tmp_path}/cache"

    def fill(n):
        keys = spark.range(10 * n, 10 * n + 30).select(F.concat(F.lit("key "), "id").alias("k"), F.lit(n).alias("writer"))
        return ledger.put_absent(keys.unionByName(keys).unionByName(spark.sql("select cast(null as string) k, 9 writer")), ["k"], path)

    with ThreadPoolExecutor(4) as pool:
        added = sum(pool.map(fill, range(6)))
    keys = [r.k for r in ledger.published(spark, path).collect()]
    assert added == len(keys) == 80 and sorted(keys) == sorted(f"key {i}" for i in range(80))
    assert ledger.put_absent(spark.range(5).select(F.concat(F.lit("key "), "id").alias("k"), F.lit(7).alias("writer")), ["k"], path) == 0
    spark.range(3).write.parquet(f"{path}/data/left_by_a_dead_writer")
    assert ledger.published(spark, path).count() == 80 and ledger.published(spark, f"{tmp_path}/none") is None


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_ranges_only(spark, tmp_path):
    path, part = f"{tmp_path}/ranges", F.floor(F.col("k") / 10)
    sinks.write_ranges(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["k"], path, part)
    before = files(path)
    assert len(before) == 10
    new = spark.createDataFrame([(3, "new"), (57, "new"), (205, "new")], "k long, v string")
    assert sinks.upsert_ranges(new, ["k"], path, part) == 3
    after, held = files(path), {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert held == {**{i: "old" for i in range(100)}, 3: "new", 57: "new", 205: "new"}
    kept = {f for f in before if "/part=0/" not in f and "/part=5/" not in f}
    assert kept == before & after and len(after - before) == 3
    # without inserting: only ranges that have one of the keys are touched
    assert sinks.upsert_ranges(spark.createDataFrame([(4, "x"), (999, "x"), (206, "x")], "k long, v string"), ["k"], path, part, insert=False) == 1
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {**held, 4: "x"}
    now = files(path)
    assert sinks.upsert_ranges(new.where("k < 0"), ["k"], path, part) == 0 and sinks.upsert_ranges(new.where("k = 999"), ["k"], path, part, insert=False) == 0
    assert files(path) == now


def test_statistics_by_file_after_replays(spark, tmp_path):
    source, kept, check = (f"{tmp_path}/{n}" for n in ("in", "kept", "check"))
    r, all_rows = random.Random(1), []

    def more(n):
        rows = [(len(all_rows) + i, [1e6 + r.random(), r.gauss(0, 1), float(i)]) for i in range(n)]
        all_rows.extend(rows)
        spark.createDataFrame(rows, "id long, v array<double>").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(source)
        keep_statistics(stream, lambda b: st.by_dimension(b, "v", "file"), kept, check, "dim").awaitTermination()
        return {x.dim: tuple(x[c] for c in ("n", "mean", "low", "high", "std")) for x in statistics(spark, kept, "dim").collect()}

    def full():
        v = np.array([x for _, x in all_rows])
        return {d: (len(v), v[:, d].mean(), v[:, d].min(), v[:, d].max(), v[:, d].std()) for d in range(3)}

    def same(a, b):
        return a.keys() == b.keys() and all(x[0] == y[0] and np.allclose(x[1:], y[1:], rtol=1e-9) for x, y in ((a[d], b[d]) for d in a))

    more(50)
    more(7)
    assert same(run(), full())
    shutil.copytree(check, f"{check}.old")
    more(20)
    first = run()
    assert same(first, full())
    # the checkpoint of a while ago: the last batch runs again, into the same folder
    shutil.rmtree(check)
    shutil.copytree(f"{check}.old", check)
    assert run() == first and run() == first
    assert unreadable(spark, kept, 3, "dim").count() == 0 and unreadable(spark, kept, 4, "dim").count() == 3


def plain_level(values, bins):
    level = histograms.FINEST
    while math.floor(max(values) / 2.0**level) - math.floor(min(values) / 2.0**level) >= bins or max(map(abs, values)) >= 2.0 ** (level + 52):
        level += 1
    return level


@pytest.mark.parametrize("bins", [4, 64, 1000])
def test_doubling_histograms(spark, bins):
    """Whatever the partitions and their order, counts are those of the grid, and quantiles are within a bin."""
    r = random.Random(bins)
    makers = [lambda: r.gauss(0, 1), lambda: 5.0, lambda: -1e9 * r.random(), lambda: r.expovariate(1e-3), lambda: float(r.randrange(-3, 4)), lambda: 0.0, lambda: 1e15]
    rows = [([m() for m in makers],) for _ in range(500)] + [([None, float("nan"), float("inf")],), (None,), ([],)]
    want = [[x[0][d] for x in rows[:500]] for d in range(len(makers))]
    results = []
    for n in (1, 5):
        frame = spark.createDataFrame(rows, "v array<double>").repartition(n)
        held = histograms.merged_histograms(histograms.partial_histograms(frame, "v", bins), bins)
        results.append(sorted(map(tuple, held.collect())))
        for q in histograms.quantiles(held, [0.01, 0.5, 0.9]).collect():
            exact = sorted(want[q.group])
            for share, name in ((0.01, "q01"), (0.5, "q50"), (0.9, "q90")):
                true = exact[math.ceil(share * len(exact)) - 1]
                assert q[name] <= true < q[name] + q.width and q.width <= max(2.0**histograms.FINEST, exact[-1] / 2**51, 4 * (exact[-1] - exact[0]) / bins)
    assert results[0] == results[1]
    for d, values in enumerate(want):
        level = plain_level(values, bins)
        counts = {}
        for x in values:
            counts[math.floor(x / 2.0**level)] = counts.get(math.floor(x / 2.0**level), 0) + 1
        assert {b: k for g, _, b, k in results[0] if g == d} == counts and {e for g, e, _, _ in results[0] if g == d} == {level}
    empty = histograms.partial_histograms(spark.createDataFrame([], "v array<double>"), "v", bins)
    assert histograms.merged_histograms(empty, bins).count() == 0


def test_nearest_at_any_distance(spark):
    """A group that holds most rows, ties, groups without events, nulls."""
    r = random.Random(4)
    groups = ["hot"] * 8 + ["b", "c", None]
    events = [(r.choice(groups[:-2] + [None]), r.randrange(0, 3000), i, f"e{i}") for i in range(400)] + [("hot", None, 900, "no time")]
    points = [(i, r.choice(groups), r.randrange(-100, 3200)) for i in range(500)] + [(1000, "hot", None)]
    e = spark.createDataFrame(events, "g string, at long, id long, name string").repartition(3)
    p = spark.createDataFrame(points, "p long, g string, t long").repartition(3)
    got = {x.p: (x.off, x.name) for x in asof.nearest(p, e, "g", "t", "at", "id", ["name"]).collect()}
    for k, g, t in points:
        near = [(abs(at - t), i, name) for h, at, i, name in events if g is not None and h == g and at is not None] if t is not None else []
        assert got[k] == ((min(near)[0], min(near)[2]) if near else (None, None))
    assert len(got) == 501 and asof.nearest(p, e.where("id < 0"), "g", "t", "at", "id", ["name"]).where("name is null").count() == 501
