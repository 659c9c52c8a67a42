"""Data sets by type."""

import json

import pytest
from pyspark.sql import functions as F

from trajlake import datasets
from trajlake.functions import schedules


def test_types_and_parameters(spark, smallest, tmp_path):
    config = {"common": {"num_video_frames": 4, "other": 1}, "dataset": {"dataset_dir": smallest, "sampling_mode": "strict", "values": False, "params": {"video_action_freq_ratio": 3, "image_aug": True}}}
    rows = datasets.create(spark, config)
    sizes = {r["count"] for r in rows.groupBy("user_id").count().collect()}
    assert sizes == {12} and rows.first().augmented and not datasets.create(spark, config, val=True).first().augmented
    few = datasets.create(spark, {"dataset": {"type": "episodes", "dataset_dir": smallest, "max_episodes": 3, "task_name": "click"}})
    assert few.select("user_id").distinct().count() == 3 and few.where("value is null").count() == 0
    with pytest.raises(ValueError, match="type 'nothing' is none of episodes, manifest, vectors"):
        datasets.create(spark, {"dataset": {"type": "nothing"}})
    with pytest.raises(ValueError, match="vectors takes no sampling_mode"):
        datasets.create(spark, {"dataset": {"type": "vectors", "dataset_dir": smallest, "sampling_mode": "strict"}})
    (tmp_path / "manifest.jsonl").write_text("".join(json.dumps({"path": f"p{i}", "label": i % 2, "split": "clean"}) + "\n" for i in range(6)))
    rows = datasets.create(spark, {"dataset": {"type": "manifest", "dataset_dir": str(tmp_path), "label": 1}}).orderBy("number")
    assert [r.path for r in rows.collect()] == ["p1", "p3", "p5"]
    own = datasets.create(spark, {"dataset": {"type": "vectors", "dataset_dir": smallest, "task_name": "3"}}).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count_distinct("task").alias("n")).first()
    assert 0 <= own.a < own.b <= 1 and own.n == 1


def test_a_type_of_ones_own(spark):
    @datasets.builder("numbers")
    def numbers(spark, *, n, val=False):
        return spark.range(n)

    try:
        assert datasets.create(spark, {"common": {"n": 2}, "dataset": {"type": "numbers", "n": 5}}).count() == 5
    finally:
        del datasets._BUILDERS["numbers"]


def test_steps_by_hooks(spark):
    x = spark.createDataFrame([(8.0,)], "x double")
    assert x.select(schedules.stepped_by(F.col("x"), [1.0, 0.5, 0.0], lambda x, now: x * now).alias("x")).first().x == (8 - 8 * 0.5) * (1 - 0.25)
    assert x.select(schedules.stepped_by(F.col("x"), [1.0], lambda x, now: x).alias("x")).first().x == 8


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A driver that was started elsewhere, with the repository on its own path only."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
q = __spark_entry__.queries()
print("rows", *(q[n](spark, "/root/testdata/sf0.001").count() for n in ("stateful_draws", "stats_doubling_quantiles", "hooked_encoder")))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    counts = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("rows")]
    assert counts and all(int(c) > 0 for c in counts[0]), done.stderr[-2000:]
