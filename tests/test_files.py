"""Readers, writers and streams: round trips through files."""

import pytest
from pyspark.sql import functions as F

from trajlake import sinks, sources, streaming


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("a", 1, [1, 2]), ("b", 0, None)], "path string, label long, video_indices array<long>")
    sinks.write_manifest(rows, path)
    got = sources.read_manifest(spark, path).select("path", "label", "video_indices", "neg_type").collect()
    assert sorted(map(tuple, got)) == [("a", 1, [1, 2], None), ("b", 0, None, None)]


def test_malformed_manifest_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"path": "a"}\n\n{broken\n')
    with pytest.raises(Exception):
        sources.read_manifest(spark, str(tmp_path / "x.json")).collect()


def test_catalog_from_folders(spark, tmp_path):
    for kind, ext, names in (("qpos", "pt", "012"), ("videos", "mp4", "013"), ("metas", "txt", "0134")):
        for n in names:
            f = tmp_path / "clean" / "task" / kind / f"{n}.{ext}"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text("x")
    files = sources.listing(spark, str(tmp_path))
    got = sources.episode_catalog(files, ("qpos", "videos", "metas")).collect()
    assert sorted(r.episode for r in got) == ["0", "1"] and got[0].split == "clean" and got[0].task == "task"
    assert [r.folder.rsplit("/", 1)[1] for r in sources.leaf_folders(files, ("qpos", "metas")).collect()] == ["task"]
    assert sources.pruned(files, skip=("videos",)).count() == 7


def test_line_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    assert [(r.line_no, r.line) for r in sources.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "x"), (1, ""), (2, "y")]


def test_partitioned_samples_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "flip", "clean", "t"), (2, "swap", "clean", "t"), (3, "flip", "clean", "u")], "k int, neg_type string, split string, task string")
    sinks.write_samples(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("neg_type = 'flip'").count() == 2 and back.count() == 3
    assert sinks.write_counted(rows, str(tmp_path / "c"), n=F.count("*"), flips=F.count_if(F.col("neg_type") == "flip")) == {"n": 3, "flips": 2}


def test_rewrites(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x"), (3, "c")], "k long, v string")
    sinks.rewrite_upserted(old, new, ["k"], str(tmp_path / "u"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "u")).collect())) == [(1, "a"), (2, "x"), (3, "c")]
    sinks.append_missing(new, old, ["k"], str(tmp_path / "n"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "n")).collect()] == [3]
    sinks.write_report(old, str(tmp_path / "r"), "%d: %s", "k", "v")
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).orderBy("value").collect()] == ["1: a", "2: b"]
    lines = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    assert [r.value for r in sinks.instruction_file(lines, "t", "scene: ").collect()] == ["scene: a", "scene: b", "scene: "]


def test_cache_actions_and_features(spark):
    flags = spark.createDataFrame([(False, True, False), (False, False, True), (True, True, True), (False, False, False)], "o boolean, p boolean, f boolean")
    assert [r.a for r in flags.select(sinks.cache_action(F.col("o"), F.col("p"), F.col("f")).alias("a")).collect()] == ["skip", "repair", "encode", "encode"]
    info = spark.sql("select map('x', named_struct('dtype', 'float', 'shape', array(1D))) as features")
    got = sinks.with_feature(info, "y", "video", [3, 4]).first().features
    assert set(got) == {"x", "y"} and got["y"].shape == [3.0, 4.0]


def test_cache_fills_in_steps(spark, tmp_path):
    source, cache, check = (str(tmp_path / x) for x in ("in", "cache", "check"))

    def run():
        stream = spark.readStream.schema("k long, v string").parquet(source)
        streaming.fill_cache(stream, lambda b: b.select("k", F.upper("v").alias("v")), ["k"], cache, check).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(cache).collect()))

    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string").write.mode("append").parquet(source)
    assert run() == [(1, "A"), (2, "B")]
    spark.createDataFrame([(2, "z"), (3, "c")], "k long, v string").write.mode("append").parquet(source)
    assert run() == [(1, "A"), (2, "B"), (3, "C")]


def test_windowed_counts(spark, smallest, tmp_path):
    path = f"{smallest}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path.replace("events.parquet", "events.parque*"))
    counts = streaming.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) as n from counts").first().n == spark.read.parquet(path).count()


def test_roots_saved_and_metadata(spark, tmp_path):
    for f in ("a/task/pt/1.pt", "a/task/pt/2.txt", "b/x/pt/3.pt", "b/x/other/4.pt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    roots = [f"{tmp_path}/a", f"{tmp_path}/b"]
    found = sources.collected(spark, roots, "*.pt", ("pt",)).collect()
    assert [(r.root, r.stem) for r in found] == [(roots[0], "1"), (roots[1], "3")]
    with pytest.raises(ValueError):
        sources.collected(spark, [], "*")
    first = sources.saved(spark, f"{tmp_path}/saved", lambda: spark.range(3).toDF("k"))
    again = sources.saved(spark, f"{tmp_path}/saved", lambda: spark.range(9).toDF("k"))
    assert first.count() == again.count() == 3
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/info.json").write_text('{"total_episodes": 5,\n "fps": 30, "features": {"x": 1}}')
    assert tuple(sources.metadata(spark, str(tmp_path)).first()) == (5, None, 30.0)
    doc = spark.sql("""select '{"common": {"seed": 1}, "model": {"expert": {"dim": 2}}}' as d""")
    assert tuple(doc.select(*sources.sections(F.col("d"), "common", "model.expert", "model.none")).first()) == ('{"seed":1}', '{"dim":2}', None)


def test_leaf_search_stops_at_the_first(spark):
    files = spark.createDataFrame([(f"/r/{p}/f", f"/r/{p}") for p in ("d/videos", "d/qpos", "d/videos/e/videos", "d/videos/e/qpos", "g/videos", "h/qpos", "h/videos")], "path string, parent string")
    assert sorted(r.folder for r in sources.leaf_folders(files, ("videos", "qpos")).collect()) == ["/r/d", "/r/h"]


def test_rewrites(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "z"), (9, "q")], "k long, v string")
    assert not sinks.rewrite_one(old, new.where("k = 9"), ["k"], f"{tmp_path}/none") and not (tmp_path / "none").exists()
    assert sinks.rewrite_one(old, new, ["k"], f"{tmp_path}/one")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/one").select("k", "v").collect())) == [(1, "a"), (2, "z")]
    assert sorted(map(tuple, sinks.patched_prefix(old, new, "k", 2).collect())) == [(1, "a"), (2, "b")]
    sinks.write_split_manifest(old, new.withColumn("reason", F.lit("late")), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m/samples").count() == 2 and {r.reason for r in spark.read.json(f"{tmp_path}/m/skipped").collect()} == {"late"}
    files = spark.createDataFrame([("r/t1/aloha_clean/videos/1.mp4",), ("t2/rand/qpos/2.pt",), ("x.txt",)], "path string")
    assert [r.new for r in sinks.moved_layout(files).orderBy("old").collect()] == ["r/clean/t1/videos/1.mp4", "randomized/t2/qpos/2.pt"]
