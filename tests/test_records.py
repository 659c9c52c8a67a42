"""Manifests with places, hooks, progress, chat contents, and checks that raise."""

import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajlake import sources
from trajlake.functions import chat, vectors
from trajlake.operators import hooks, windows
from trajlake.streaming import progress


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "50"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(tmp_path, files):
    for name, lines in files.items():
        (tmp_path / name).write_bytes("".join(lines).encode())
    return str(tmp_path)


def test_places_of_lines_in_small_splits(spark, small_splits, tmp_path):
    r = random.Random(1)
    files = {f"f{k}.txt": ["é" * r.randrange(0, 60) + r.choice(["", "x", "\t"]) + r.choice(["\n", "\r\n"]) for _ in range(r.randrange(1, 60))] for k in range(4)}
    files["f2.txt"].append("no newline at the end")
    rows = sources.located_lines(spark, write(tmp_path, files))
    assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = [(x.file.rsplit("/", 1)[1], x.offset, x.line_no, x.number, x.line) for x in rows.orderBy("number").collect()]
    want, number = [], 0
    for name in sorted(files):
        at = 0
        for k, line in enumerate(files[name]):
            want.append((name, at, k, number, line.rstrip("\n").removesuffix("\r")))
            at, number = at + len(line.encode()), number + 1
    assert got == want


def test_manifest_in_order_and_malformed_lines(spark, small_splits, tmp_path):
    lines = [json.dumps({"path": f"p{i}", "label": i % 2, "video_indices": [i, i + 1]}) + "\n" for i in range(30)]
    lines.insert(7, "\n")
    path = write(tmp_path, {"m.jsonl": lines})
    got = sources.located_manifest(spark, path).orderBy("number").select("path", "label", "video_indices", "line_no").collect()
    assert [(x.path, x.label, x.video_indices) for x in got] == [(f"p{i}", i % 2, [i, i + 1]) for i in range(30)] and got[7].line_no == 8
    lines.insert(20, '{"path": "broken", \n')
    at = len("".join(lines[:20]).encode())
    path = write(tmp_path, {"m.jsonl": lines})
    with pytest.raises(Exception, match=rf"malformed line 21 at byte {at} of .*m\.jsonl: \{{\"path\": \"broken\""):
        sources.located_manifest(spark, path).select("number").collect()
    with pytest.raises(Exception, match="malformed line 21"):
        sources.located_manifest(spark, path).orderBy("number").collect()


def test_hooks_leave_batches_whole(spark, tmp_path):
    marks = str(tmp_path)

    def set_up():
        import os
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        sizes = []

        def hook(batch):
            sizes.append(batch.num_rows)
            x = batch.column("x").to_pylist()
            if any(v is not None and v % 10 == 3 for v in x):
                raise KeyError(f"bad among {len(x)}")
            assert batch.num_rows <= 8 and os.path.isdir(marks)
            return pa.table({"y": pa.array([None if v is None else v * 2 for v in x]), "n": pa.array([max(sizes)] * len(x))})

        return hook

    rows = spark.range(100).select(F.when(F.col("id") != 50, F.col("id")).alias("x"), F.lit("kept").alias("other")).repartition(3)
    out = hooks.hooked(rows, set_up, "y long, n int", rows_per_call=8)
    assert out.columns == ["x", "other", "y", "n", "ok", "err"]
    got = out.collect()
    assert len(got) == 100 and all(r.other == "kept" for r in got)
    for r in got:
        if r.x is not None and r.x % 10 == 3:
            assert not r.ok and r.y is None and r.err == "KeyError: 'bad among 1'"
        else:
            assert r.ok and r.err is None and r.y == (None if r.x is None else 2 * r.x)
    assert len(list(tmp_path.iterdir())) == 3  # once a task
    large = spark.range(6).select(F.repeat(F.lit("x"), 1000).alias("t"), "id").repartition(1)
    sizes = hooks.hooked(large, lambda: lambda b: {"n": [b.num_rows] * b.num_rows}, "n int", bytes_per_call=2500).select("n").collect()
    assert {r.n for r in sizes} == {2}
    wrong = hooks.hooked(large, lambda: lambda b: {"n": [1, 2, 3, 4, 5, 6, 7]}, "n int").select("ok", "err").collect()
    assert all(not r.ok and r.err == "ValueError: the hook gave 7 values for 1 rows" for r in wrong)
    with pytest.raises(ValueError, match="there already: id"):
        hooks.hooked(large, lambda: lambda b: {}, "id long")
    assert hooks.hooked(rows.where("x < 0"), set_up, "y long, n int").count() == 0


def test_progress_every_so_many_rows(spark, tmp_path):
    source, told = f"{tmp_path}/in", []
    for k in range(5):
        spark.range(40 * k, 40 * k + 40).coalesce(1).write.mode("append").parquet(source)
    listener = progress.Progress("done", 100, told.append)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        watched = progress.counted(stream, "done", odd=F.count_if(F.col("id") % 2 == 1))
        watched.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # events come a little later
            if listener.totals.get("rows") == 200:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals == {"rows": 200, "odd": 100} and [t["rows"] for t in told] == [120, 200]


def test_media_of_contents(spark):
    contents = [
        "look at [this]", "[]", None,
        json.dumps([{"type": "text", "text": "a"}, {"type": "image", "image": "i1"}, {"video": "v1", "fps": 2}, {"type": "image_url", "image_url": "u1"}]),
        json.dumps([{"type": "other", "image": "i2"}, {"text": "x"}, {"type": "video", "video": ["f1", "f2"]}]),
    ]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "k int, c string")
    got = {r.k: [tuple(m) for m in r.m] for r in rows.select("k", chat.media(F.col("c")).alias("m")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [("image", "i1"), ("video", "v1"), ("image", "u1")], 4: [("image", "i2"), ("video", '["f1","f2"]')]}
    with pytest.raises(Exception, match="no source"):
        spark.sql("""select '[{"type": "video"}]' as c""").select(chat.media(F.col("c")).alias("m")).collect()


def test_media_counts_wrap_around(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([1, 4, 5, 9]) for _ in range(r.randrange(1, 12))]) for i in range(80)]
    frame = spark.createDataFrame(rows, "k int, ids array<int>")
    got = {x.k: (x.images, x.videos) for x in frame.select("k", *chat.media_counts(F.col("ids"), 1, 4, 5)).collect()}
    for k, ids in rows:
        before = np.roll(np.array(ids) == 1, 1)
        assert got[k] == (int((before & (np.array(ids) == 4)).sum()), int((before & (np.array(ids) == 5)).sum()))


def test_frame_counts_that_raise(spark):
    count = lambda n, rate=10.0, asked=None, **k: spark.range(1).select(windows.checked_even_count(F.lit(n).cast("long"), F.lit(rate), 2.0, asked=F.lit(asked).cast("long"), **k).alias("c")).first().c
    assert count(100) == 20 and count(100, asked=7) == 8 and count(1000, 1.0) == 768 and count(9, 1000.0) == 4 and count(1000, most=31) == 30 and count(100, asked=5) == 4 and count(3) == 2
    for n, more in ((1, {}), (10, {"asked": 12}), (10, {"asked": 0}), (10, {"most": 1})):
        with pytest.raises(Exception, match="frames should be in 2"):
            count(n, **more)


def test_blocks_and_halves(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: i.cast("double")).alias("t"))
    assert rows.select(vectors.block(F.col("t"), F.lit(4)).alias("b")).first().b == [float(i) for i in range(480, 600)]
    for k in (5, -1):
        with pytest.raises(Exception, match="no token block"):
            rows.select(vectors.block(F.col("t"), F.lit(k)).alias("b")).collect()
    values = np.array([0.0, -0.0, 1.0, -2.5, 3.0e38, 1e-40, -1e-38, np.inf, -np.inf, np.nan, 65280.0], np.float32)
    bits = (values.view(np.uint32) >> 16).astype(np.int64)
    exact = (bits.astype(np.uint32) << 16).view(np.float32)
    frame = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bits)], "k int, b int")
    got = np.array([r.x for r in frame.select("k", vectors.to_single(F.col("b")).alias("x")).orderBy("k").collect()], np.float32)
    assert np.array_equal(got, exact, equal_nan=True)
