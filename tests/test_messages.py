"""Hand-written edges of period, clean-up, device count and device flags."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metertide.functions.text import WHITESPACE, strip_whitespace
from metertide.functions.time import (
    compact_midnight,
    midnight,
    parse_timestamp,
    previous_day,
    reading_timestamp,
    run_name,
    timestamp_text,
)
from metertide.operators.messages import (
    clean_messages,
    distinct_messages,
    dropped_devices,
    filter_messages,
    in_period,
    initial_device_count,
)
from tests.builders import message, messages

START, END = "2024-01-03", "2024-01-28"


def ids(df):
    return sorted(row.DeviceID for row in df.collect())


def test_both_ends_are_kept_and_the_rest_of_the_end_day_is_not(spark):
    df = messages(
        spark,
        message("first", "2024-01-03T00:00:00"),
        message("too early", "2024-01-02T23:59:59"),
        message("last", "2024-01-28T00:00:00"),
        message("too late", "2024-01-28T00:00:01"),
    )
    assert ids(in_period(df, START, END)) == ["first", "last"]


def test_message_date_folder_column_is_used_and_dropped(spark):
    df = messages(spark, message("D1", "2024-01-05T10:00:00")).withColumn(
        "message_date", F.lit("2024-01-05").cast("date")
    )
    kept = in_period(df, START, END)
    assert "message_date" not in kept.columns and kept.count() == 1


def test_duplicates_are_whole_rows(spark):
    df = messages(
        spark, message("D1", seq=1), message("D1", seq=1), message("D1", seq=2), message("D1 ", seq=1)
    )
    assert distinct_messages(df).count() == 3
    assert filter_messages(df, START, END).count() == 3


@pytest.mark.parametrize(
    "text",
    [
        "2024-01-05",
        "2024-01-05 10:00:00",
        "2024-01-05T10:00:00.5",
        "2024-01-05T10:00:00Z",
        "2024-01-05T10:00+01",
        "2024-01-05T10:00:0Z",
        "2024-1-5T10:00:00",
        "2024-13-05T10:00:00",
        "2024-01-05T25:00:00",
        " 2024-01-05T10:00:00",
        "2024-01-05T10:00:00\n",
        "later",
        "",
    ],
)
def test_malformed_timestamp_raises_or_becomes_null(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID|DateTimeException|malformed"):
        df.select(parse_timestamp(F.col("t"))).collect()
    assert df.select(parse_timestamp(F.col("t"), "null")).first()[0] is None


def test_timestamp_round_trip_and_null(spark):
    df = spark.createDataFrame([("2024-02-29T23:59:59",), (None,)], "t string")
    parsed = df.select(parse_timestamp(F.col("t")).alias("t"))
    assert parsed.first()[0] == datetime(2024, 2, 29, 23, 59, 59)
    assert [row[0] for row in parsed.select(timestamp_text(F.col("t"))).collect()] == [
        "2024-02-29T23:59:59",
        None,
    ]


def test_timestamp_text_drops_the_fraction_and_needs_no_time_zone(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00.999999",)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        text = df.select(timestamp_text(F.col("t").cast("timestamp_ntz"))).first()[0]
        back = df.select(parse_timestamp(F.lit("2024-03-10T02:30:00"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert text == "2024-03-10T02:30:00" and back == datetime(2024, 3, 10, 2, 30)


def test_unknown_error_mode_is_refused(spark):
    with pytest.raises(ValueError):
        parse_timestamp(F.col("t"), "skip")


def test_strip_takes_all_whitespace_and_only_at_the_ends(spark):
    texts = ["D1", "D1 ", "\tD1", "\nD 1\r\n", "　D1\xa0", "éD1é", "", " ", None, "D"]
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    stripped = [row[0] for row in df.select(strip_whitespace(F.col("t"))).collect()]
    assert stripped == [None if text is None else text.strip(WHITESPACE) for text in texts]


def test_strip_set_is_unicode_white_space():
    # Python also strips the four information separators, which are not White_Space.
    separators = set("\x1c\x1d\x1e\x1f")
    assert set(WHITESPACE) == {chr(n) for n in range(0x3100) if chr(n).isspace()} - separators


def test_clean_keeps_full_hourly_messages_only(spark):
    df = messages(
        spark,
        message("\tD1 ", readings=8),
        message("few", readings=4),
        message("other type", kind=2),
        message("other interval", xtime=1),
        message("no readings", readings=None),
    )
    rows = clean_messages(df).collect()
    assert [row.device_id for row in rows] == ["D1"]
    assert rows[0].timestamp == datetime(2024, 1, 5, 10, 0) and rows[0].FLOW8 == 8


def test_clean_is_strict_about_numbers(spark):
    df = messages(spark, message("D1")).withColumn("FLOW3", F.lit("three"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean_messages(df).collect()
    assert clean_messages(df, "null").first().FLOW3 is None


def test_device_count_takes_ids_as_sent_and_counts_null(spark):
    df = messages(
        spark, *[message(device) for device in ("D1", "D1 ", "\tD1", "D1", None, None)]
    )
    assert initial_device_count(df).first().num_devices == 4
    assert initial_device_count(df.limit(0)).first().num_devices == 0


@pytest.mark.parametrize(
    ("readings", "xtimes", "expected"),
    [
        ([8, 8], [4, 4], None),
        ([8, 4], [4, 4], (True, False, True, True, False)),
        ([4, 4], [4, 4], (False, False, True, True, True)),
        ([8, 9], [4, 4], (False, True, True, True, True)),
        ([8, 8], [4, 1], (True, True, True, False, False)),
        ([8, 8], [1, 1], (True, True, False, False, True)),
        ([8, 4], [1, 1], (True, False, False, False, True)),
    ],
)
def test_device_flags(spark, readings, xtimes, expected):
    df = messages(
        spark, *[message("D1", readings=r, xtime=x) for r, x in zip(readings, xtimes)]
    )
    rows = [tuple(row)[1:] for row in dropped_devices(df).collect()]
    assert rows == ([] if expected is None else [expected])


def test_device_flags_keep_ids_as_sent_and_null(spark):
    df = messages(spark, *[message(device, readings=4) for device in ("D1", "D1 ", None)])
    assert {row.DeviceID for row in dropped_devices(df).collect()} == {"D1", "D1 ", None}


@pytest.mark.parametrize(
    ("sent", "flow_id", "expected"),
    [
        ("2024-02-01T10:29:59", 8, datetime(2024, 2, 1, 9, 29, 59)),
        ("2024-02-01T10:30:00", 8, datetime(2024, 2, 1, 10, 30)),
        ("2024-02-01T10:30:00", 1, datetime(2024, 2, 1, 3, 30)),
        ("2024-02-01T00:10:00", 8, datetime(2024, 1, 31, 23, 10)),
        ("2024-03-01T00:10:00", 1, datetime(2024, 2, 29, 16, 10)),
    ],
)
def test_reading_timestamp(spark, sent, flow_id, expected):
    df = spark.range(1).select(F.lit(sent).cast("timestamp_ntz").alias("t"))
    assert df.select(reading_timestamp(F.col("t"), F.lit(flow_id))).first()[0] == expected


def test_run_dates_and_names(spark):
    from datetime import date

    assert previous_day(date(2024, 3, 1)) == ("2024-02-29", "2024-03-01")
    row = (
        spark.range(1)
        .select(F.lit("2024-03-01").cast("date").alias("d"))
        .select(
            compact_midnight(F.col("d")), run_name(F.lit("ns"), F.date_sub("d", 1), F.col("d"))
        )
        .first()
    )
    assert tuple(row) == ("20240301000000", "ns_2024-02-29_2024-03-01")
    assert spark.range(1).select(midnight("2024-1-3")).first()[0] == datetime(2024, 1, 3)
    with pytest.raises(ValueError):
        midnight("yesterday")
