"""Readings per hour and flows per day."""

from collections import defaultdict
from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st

from metertide.operators.flows import daily_flows, daily_flows_of_messages, unpack_flows
from metertide.schemas import CLEAN, FLOWS


def clean(spark, *rows):
    return spark.createDataFrame([(d, t, *f) for d, t, f in rows], CLEAN)


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def expected_days(rows):
    """Reading by reading, in plain Python."""
    groups = defaultdict(list)
    for device, sent, flows in rows:
        for number, flow in enumerate(flows, start=1):
            back = 8 - number + (1 if sent.minute < 30 else 0)
            groups[device, (sent - timedelta(hours=back)).date()].append(flow)
    result = []
    for (device, day), flows in groups.items():
        known = [flow for flow in flows if flow is not None]
        if known:
            result.append((device, day, sum(known), min(known), max(known) == 255))
        else:
            result.append((device, day, None, None, None))
    return sorted(result, key=str)


def test_hours_before_and_from_half_past(spark):
    for minute, last in ((29, 9), (30, 10)):
        df = clean(spark, ("D1", datetime(2024, 2, 1, 10, minute), range(1, 9)))
        flows = unpack_flows(df)
        assert flows.schema == FLOWS
        assert rows_of(flows.select("hour", "flow")) == sorted(
            [(last - 8 + n, n) for n in range(1, 9)], key=str
        )


def test_readings_of_the_day_before(spark):
    df = clean(spark, ("D1", datetime(2024, 3, 1, 0, 10), range(1, 9)))
    assert {(r.date, r.hour) for r in unpack_flows(df).collect()} == {
        (date(2024, 2, 29), hour) for hour in range(16, 24)
    }


def test_null_readings_stay_and_overlaps_count_twice(spark):
    sent = datetime(2024, 1, 5, 12, 45)
    df = clean(spark, ("D1", sent, [None] * 8), ("D1", sent, [1] * 8), ("D1", sent, [1] * 8))
    assert unpack_flows(df).count() == 24
    assert daily_flows(unpack_flows(df)).first().total_flow == 16


def test_clipped_is_exactly_255(spark):
    sent = datetime(2024, 1, 5, 12, 45)
    for most, clipped in ((254, False), (255, True), (256, False)):
        df = clean(spark, ("D1", sent, [1] * 7 + [most]))
        assert daily_flows(unpack_flows(df)).first().clipped is clipped
        assert daily_flows_of_messages(df).first().clipped is clipped


def test_day_without_known_readings_has_nulls(spark):
    rows = [("D1", datetime(2024, 1, 5, 3, 45), [None] * 4 + [7] * 4)]
    df = clean(spark, *rows)
    assert rows_of(daily_flows(unpack_flows(df))) == expected_days(rows)
    assert rows_of(daily_flows_of_messages(df)) == expected_days(rows)


def test_null_device_and_null_time_stay(spark):
    df = clean(spark, (None, datetime(2024, 1, 5, 12, 45), [1] * 8), ("D1", None, [2] * 8))
    expected = [("D1", None, 16, 2, False), (None, date(2024, 1, 5), 8, 1, False)]
    assert rows_of(daily_flows(unpack_flows(df))) == sorted(expected, key=str)
    assert rows_of(daily_flows_of_messages(df)) == sorted(expected, key=str)


READING = st.one_of(st.none(), st.sampled_from([0, 1, 254, 255]), st.integers(0, 300))
MESSAGE = st.tuples(
    st.sampled_from(["D1", "D2", None]),
    st.datetimes(datetime(2024, 2, 27), datetime(2024, 3, 3)),
    st.lists(READING, min_size=8, max_size=8),
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(MESSAGE, min_size=1, max_size=20))
def test_both_ways_give_what_plain_python_gives(spark, rows):
    df = clean(spark, *rows)
    flows = unpack_flows(df)
    assert flows.count() == 8 * len(rows)
    assert rows_of(daily_flows(flows)) == expected_days(rows)
    assert rows_of(daily_flows_of_messages(df)) == expected_days(rows)
