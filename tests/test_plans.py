"""What the plans must look like to hold at size."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from metertide.operators.flows import daily_flows_of_messages, unpack_flows
from metertide.operators.messages import (
    clean_messages,
    distinct_messages,
    dropped_devices,
    filter_messages,
    initial_device_count,
)
from metertide.operators.ordering import exact_median, with_row_index
from metertide import workspace
from metertide.operators.runs import consecutive_flow_state, find_leaks, flow_runs, stored_runs
from metertide.operators.stats import dropped_device_stats
from metertide.operators.usage import device_usage
from metertide.plans.reports import build_reports
from metertide.workspace import materialize
from tests.builders import day, days, message, messages

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Shuffles between the input and the result, leaving out those of subqueries."""
    return re.findall(r"Exchange (\w+)", plan_of(df).replace("BroadcastExchange", "Broadcast"))


@pytest.fixture(scope="module")
def stored(spark):
    return materialize(messages(spark, message("D1"), message("D2")), "messages")


@pytest.fixture(scope="module")
def stored_days(spark):
    return materialize(days(spark, day("D1", 1, 5), day("D1", 2, 5)), "days")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_all_rows_or_leaves_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan


def test_clean_up_reads_its_columns_and_pushes_its_filters(stored):
    plan = plan_of(clean_messages(stored))
    read = re.search(r"ReadSchema: struct<(.*?)>", plan)[1]
    assert {field.split(":")[0] for field in read.split(",")} == {
        "DeviceID", "Timestamp", "msgType", "readings", "xtime", *(f"FLOW{n}" for n in range(1, 9)),
    }
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    for condition in ("EqualTo(readings,8)", "EqualTo(msgType,1)", "EqualTo(xtime,4)"):
        assert condition in pushed


def test_device_health_reads_three_columns(stored):
    read = re.search(r"ReadSchema: struct<(.*?)>", plan_of(dropped_devices(stored)))[1]
    assert read == "DeviceID:string,readings:int,xtime:int"
    assert re.search(r"ReadSchema: struct<(.*?)>", plan_of(initial_device_count(stored)))[1] == "DeviceID:string"


def test_unpacking_needs_no_shuffle(stored):
    assert exchanges(unpack_flows(clean_messages(stored))) == []


def test_day_flows_are_combined_before_their_only_shuffle(stored):
    df = daily_flows_of_messages(clean_messages(stored))
    assert exchanges(df) == ["hashpartitioning"]
    below = plan_of(df).split("Exchange")[1]
    assert "partial_sum" in below and "Generate inline" in below


def test_collecting_and_filtering_shuffle_once(stored):
    df = filter_messages(distinct_messages(stored.union(stored)), "2024-01-01", "2024-01-31")
    assert exchanges(df) == ["hashpartitioning"]


def test_leaks_of_days_shuffle_once(stored_days):
    assert exchanges(find_leaks(flow_runs(stored_days))) == ["hashpartitioning"]


@pytest.fixture
def written_plans(monkeypatch):
    """Plans of all intermediate tables, by name; the final plan is the test's own."""
    plans = {}

    def noting(function):
        def call(df, *rest):
            plans.setdefault(rest[-1], []).append(plan_of(df))
            return function(df, *rest)

        return call

    monkeypatch.setattr("metertide.operators.runs.materialize_by_key", noting(workspace.materialize_by_key))
    monkeypatch.setattr("metertide.operators.ordering.materialize", noting(workspace.materialize))
    return plans


def days_read_or_moved(plan):
    """Lines of a plan that shuffle or window columns only days have."""
    return [
        line
        for line in plan.splitlines()
        if re.search(r"\bExchange (hash|range|Single|Round)|\bWindow \[", line) and "BroadcastExchange" not in line
    ]


def test_days_are_shuffled_and_windowed_once_over_all_jobs(spark, stored_days, written_plans):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many devices
    try:
        df = consecutive_flow_state(stored_days)
        final = plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (stored,) = written_plans["device-days"]
    assert stored.count("Exchange hashpartitioning(device_id") == 1 == stored.count("Exchange ")
    # Everything after starts from the table in buckets; what is shuffled is one row per device.
    for plan in (final, *written_plans["device-blocks"]):
        assert "Bucketed: true" in plan or "last_day" in plan
        for exchange in re.findall(r"Exchange (?:hash|range)partitioning[^\n]*", plan):
            assert "total_flow" not in exchange
    left = final[final.rindex("SortMergeJoin [device_id") :]
    scan = left[: left.index("FileScan parquet")]
    assert "Exchange" not in scan


def test_leaks_of_stored_days_need_no_shuffle(stored_days):
    assert exchanges(find_leaks(stored_runs(stored_days))) == []


def test_no_sort_precedes_a_parquet_write(spark):
    reports = build_reports(messages(spark, message("D1"), message("D2")), "2024-01-01", "2024-01-31")
    assert all("rangepartitioning" not in plan_of(df) for df in reports.values())


def test_single_partition_only_for_totals_of_blocks(spark, stored_days):
    """The windows without a partition run over one row per block."""
    for df in (
        consecutive_flow_state(stored_days),
        with_row_index(stored_days, [F.col("date")]),
        exact_median(stored_days, "total_flow"),
    ):
        plan = plan_of(df)
        for below in re.split(r"Exchange SinglePartition", plan)[1:]:
            assert re.match(r"[^\n]*\n[^\n]*Aggregate\((keys?=\[(_block|\(_row_id|shiftright|_groupingexpression)|.*partial)", below), below[:400]


def test_dropped_stats_do_not_join(stored):
    stats = dropped_device_stats(
        dropped_devices(stored),
        device_usage(daily_flows_of_messages(clean_messages(stored))),
        initial_device_count(stored),
    )
    assert "Join" not in plan_of(stats)
