"""Streams: draws that cover all sources over restarts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajlake.functions.keyed import draw, drawn
from trajlake.streaming import coverage

SOURCES, REQUESTS = "shard long, source long, windows long", "shard long, request long, draws long"


@pytest.fixture
def store(spark):
    for k, v in coverage.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in coverage.STATE_STORE:
        spark.conf.unset(k)


def plain(sources, n, seed=7):
    """(pass, place, source, window) of the first n draws of a shard."""
    out, turn = [], 0
    while len(out) < n:
        order = sorted((s for s, w in sources.items() if turn == 0 or w), key=lambda s: (drawn(seed, "pass", turn, s), s))
        out += [(turn, k, s, drawn(seed, "window", turn, s) % sources[s]) for k, s in enumerate(order) if sources[s]]
        turn += 1
    return out[:n]


def test_python_and_column_draws_agree(spark):
    rows = spark.range(20).select("id", draw(3, "x", F.col("id")).alias("d")).collect()
    assert all(r.d == drawn(3, "x", r.id) for r in rows)


def test_restarts_go_on_where_they_ended(spark, store, tmp_path):
    """Requests come over three runs from one checkpoint; each shard's draws are those of one run."""
    held = {0: {s: s % 3 for s in range(0, 20)}, 1: {s: 2 for s in range(100, 105)}}
    src, req, out = (str(tmp_path / x) for x in ("sources", "requests", "out"))

    def run():
        streams = spark.readStream.schema(SOURCES).parquet(src), spark.readStream.schema(REQUESTS).parquet(req)
        q = coverage.draws(*streams).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()
        got = {}
        for r in spark.read.parquet(out).orderBy("shard", "draw").collect():
            got.setdefault(r.shard, []).append((r["pass"], r.place, r.source, r.window))
        return got

    spark.createDataFrame([(k, s, w) for k, v in held.items() for s, w in v.items()], SOURCES).write.mode("append").parquet(src)
    asked = Counter()
    for request, (a, b) in enumerate([(5, 1), (14, 9), (20, 5)]):
        spark.createDataFrame([(0, request, a), (1, request, b)], REQUESTS).coalesce(1).write.mode("append").parquet(req)
        asked.update({0: a, 1: b})
        got = run()
        assert got == {k: plain(held[k], asked[k]) for k in held}
    # 13 sources of shard 0 have windows, all 5 of shard 1: three passes each
    for shard, n in ((0, 13), (1, 5)):
        assert all(sorted(s for _, _, s, _ in got[shard][i * n : (i + 1) * n]) == sorted(s for s, w in held[shard].items() if w) for i in range(3))
    # a source that comes late is drawn from the next pass on
    spark.createDataFrame([(1, 999, 1)], SOURCES).write.mode("append").parquet(src)
    spark.createDataFrame([(1, 9, 6)], REQUESTS).write.mode("append").parquet(req)
    late = run()[1][15:]
    assert {s for _, _, s, _ in late} == {100, 101, 102, 103, 104, 999} and {t for t, *_ in late} == {3}


def test_no_source_with_windows(spark):
    sources, requests = spark.createDataFrame([(0, 1, 0)], SOURCES), spark.createDataFrame([(0, 0, 1)], REQUESTS)
    with pytest.raises(Exception, match="no source has a window"):
        coverage.draws(sources, requests).collect()
    assert coverage.draws(sources, requests.where("draws > 5")).count() == 0
