"""Physical plans keep the properties the operators promise."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from fleetlens.operators import history as H
from fleetlens.plans.suite import Tables
from fleetlens.sources import sinks as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,exchanges", [
    ("history_bucketed", 1), ("topic_bucketed", 1), ("locf_state", 1), ("gap_stats", 1), ("catalog", 1), ("presence_timeline", 1),
    ("relay_sample", 1), ("rule_predicate", 1), ("last_n_trail", 1), ("topic_profile", 1), ("secret_scan", 0), ("flatten_messages", 0),
    ("history_raw", 0), ("explode_samples", 0)])
def test_shuffles(spark, name, exchanges):
    text = plan(entry.queries()[name](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == exchanges
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["rules_x_robots", "incident_window", "token_status", "load_rules"])
def test_small_sides_are_broadcast_equality_joins(spark, name):
    assert "BroadcastHashJoin" in plan(entry.queries()[name](spark, SMALL))


@pytest.mark.parametrize("name", ["overflow_kept", "dedup_batches"])
def test_rank_limits_run_before_the_shuffle(spark, name):
    assert plan(entry.queries()[name](spark, SMALL)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["history_raw", "latest_samples", "events_filter", "alert_history"])
def test_limits_become_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, SMALL))


def test_scan_reads_only_needed_columns_and_days(spark):
    t = Tables(spark, SMALL)
    path = K.scratch_path(spark, "plan")
    K.write_archive(t.view("fx_samples").select("robot_id", "topic", "ts", "num", "payload", "flag"), path)
    df = H.scan_archive(spark.read.parquet(path), "2024-01-05 00:00:00", "2024-01-07 00:00:00", "amr-000003").select("ts", "num")
    text = plan(df)
    assert "PartitionFilters: [isnotnull(day" in text and "PushedFilters: [IsNotNull(" in text
    assert "payload" not in text.split("ReadSchema")[1]
    assert df.inputFiles() and df.count() >= 0
    assert H.scan_archive(spark.read.parquet(path), "2024-01-05 00:00:00", "2024-01-07 00:00:00").select("day").distinct().count() <= 2
