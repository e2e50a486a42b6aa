"""What the physical plans must and must not contain."""

import os
import re

import pytest

from studylattice import registry
from studylattice.operators import groups, leaderboard, planner
from studylattice.plans import nearest, ordered, skew

SF_DIR = "/root/testdata/sf0.001"
if not os.path.isdir(SF_DIR):
    pytest.skip("test tables are not here", allow_module_level=True)

# These run jobs of their own or fit models; their parts are covered by the others.
SLOW = {"student_groups", "group_members", "cluster_k_selection", "revision_interval_model", "attempts_stream", "compare_users_with_groups", "revision_schedule_model"}


def plan(spark, name, monkeypatch=None):
    """The query's plan; with ``monkeypatch`` checkpoints do nothing, so the plan is that of the whole
    query and not only of what follows the last checkpoint."""
    if monkeypatch is not None:
        for module in (groups, leaderboard, nearest, ordered, planner, registry, skew):
            if hasattr(module, "checkpointed"):
                monkeypatch.setattr(module, "checkpointed", lambda df: df)
    df = registry.QUERIES[name](spark, SF_DIR)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert monkeypatch is None or "Scan ExistingRDD" not in text
    return text


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_no_pairwise_joins_no_python(spark, name, monkeypatch):
    text = plan(spark, name, monkeypatch)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in text


@pytest.mark.parametrize("name", ["top_improved", "gap_micro_trend", "recent_attempts", "quiz_sample"])
def test_group_limits_come_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name))


@pytest.mark.parametrize(
    "name", ["difficulty_weights", "overall_leaderboard", "gap_forecast", "progress_leaderboard", "revision_summary", "student_profiles", "course_grades", "grade_trend"]
)
def test_raw_rows_are_aggregated_by_hashing(spark, name, monkeypatch):
    assert "SortAggregate" not in plan(spark, name, monkeypatch)


def test_numbering_moves_the_raw_rows_once(spark):
    """One shuffle to the partition of a row's piece serves the window; sums of pieces are broadcast."""
    text = plan(spark, "attempt_numbering")
    assert "Scan ExistingRDD" not in text and "rangepartitioning" not in text
    window = re.search(r"Window \[sum\(1\).*?FileScan parquet", text, re.S).group(0)
    assert window.count("Exchange shufflepartitionidpassthrough") == 1 and "Exchange hashpartitioning" not in window


def test_forecast_moves_the_raw_rows_once(spark):
    text = plan(spark, "gap_forecast")
    assert text.count("Exchange rangepartitioning") == 1
    # The other shuffles carry one row per run.
    assert text.count("Exchange hashpartitioning") <= 3


def test_scans_read_only_the_needed_columns(spark):
    schema = re.search(r"ReadSchema: (struct<[^>]*>?)", plan(spark, "difficulty_weights")).group(1)
    assert "ts" not in schema and "value" not in schema
