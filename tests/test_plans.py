"""Plans: no Python, no Cartesian product, scans read what is asked for and filters reach them."""

import re

import pytest

from trajlake import plans


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["window_strict", "gather_actions", "nearest_timestamp", "catalog_join4", "stats_hist_quantile", "coverage_batches", "neg_joint_swap", "collate_pad", "negative_draws", "global_to_local"])
def test_engine_does_the_work(name, spark, smallest):
    plan = plan_of(plans.QUERIES[name](spark, smallest))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_columns_are_pruned(spark, smallest):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(plans.QUERIES["shard_strided"](spark, smallest))))
    assert read == {"doc_id:bigint"}
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(plans.QUERIES["episode_lengths"](spark, smallest)))
    assert read == ["user_id:bigint"]


def test_filters_are_pushed(spark, smallest):
    plan = plan_of(plans.QUERIES["manifest_union"](spark, smallest))
    assert "EqualTo(quality,1)" in plan and "LessThan(n_chars,1000)" in plan


def test_ranges_meet_values_without_a_shuffle(spark, smallest):
    plan = plan_of(plans.QUERIES["normalize_minmax"](spark, smallest))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
