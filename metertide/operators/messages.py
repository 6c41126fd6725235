"""Message level: period, duplicates, clean-up, device count, device health."""

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from metertide.functions.text import strip_whitespace
from metertide.functions.time import midnight, parse_timestamp
from metertide.schemas import FLOW_COLUMNS, MESSAGES

# Partition column of the message history; lets a period skip whole folders.
MESSAGE_DATE = "message_date"
# The time of a message as a timestamp, beside its text. Where a frame has it nothing is parsed.
SENT = "sent"
# A hash of the 19 message columns, by which a bucketed history is dealt out.
ROW_HASH = "row_hash"


def with_sent(messages: DataFrame, on_error: str = "raise") -> DataFrame:
    """Messages with their time as ``sent``, parsed unless it is there already."""
    if SENT in messages.columns:
        return messages
    return messages.withColumn(SENT, parse_timestamp(F.col("Timestamp"), on_error))


def in_period(
    messages: DataFrame, start: str | date, end: str | date, on_error: str = "raise"
) -> DataFrame:
    """Messages from the first instant of ``start`` to the first instant of ``end``, both kept.

    What happens later on the end day is outside. If the frame has the ``message_date`` partition
    column of the history, whole folders are skipped as well, and the column is dropped.
    """
    first, last = midnight(start), midnight(end)
    if MESSAGE_DATE in messages.columns:
        messages = messages.filter(
            F.col(MESSAGE_DATE).between(first.cast("date"), last.cast("date"))
        ).drop(MESSAGE_DATE)
    kept = with_sent(messages, on_error).filter((F.col(SENT) >= first) & (F.col(SENT) <= last))
    return kept.select(messages.columns)


def distinct_messages(messages: DataFrame) -> DataFrame:
    """Drop whole-row duplicates.

    All 19 columns count: messages that differ only in ``msgSeq`` both stay. ``sent`` stays too, where
    there is one; it follows from the others. Copies are combined
    within each input partition first, so a heavily repeated row is not sent around. Rows of a history
    in buckets lie beside their copies already, by ``row_hash``, and are not sent around at all.
    """
    further = [name for name in (SENT, ROW_HASH) if name in messages.columns]
    return messages.select(*MESSAGES.fieldNames(), *further).distinct().drop(ROW_HASH)


def filter_messages(
    messages: DataFrame, start: str | date, end: str | date, on_error: str = "raise"
) -> DataFrame:
    """The filtered export: messages of the period, without duplicates."""
    return distinct_messages(in_period(messages, start, end, on_error))


def clean_messages(messages: DataFrame, on_error: str = "raise", *keys: str) -> DataFrame:
    """Full hourly messages only, with stripped ids and typed columns, and further columns ``keys``.

    Messages with fewer readings come only in a device's first day.
    """
    hourly = (F.col("readings") == 8) & (F.col("msgType") == 1) & (F.col("xtime") == 4)

    def whole_number(name: str) -> Column:
        column = F.col(name)
        return (column.cast("bigint") if on_error == "raise" else column.try_cast("bigint")).alias(
            name
        )

    return with_sent(messages.filter(hourly), on_error).select(
        *keys,
        strip_whitespace(F.col("DeviceID")).alias("device_id"),
        F.col(SENT).alias("timestamp"),
        *[whole_number(name) for name in FLOW_COLUMNS],
    )


def initial_device_count(messages: DataFrame) -> DataFrame:
    """One row ``num_devices``: distinct ids as sent, not stripped, with null as an id."""
    return (
        messages.select("DeviceID").distinct().agg(F.count(F.lit(1)).alias("num_devices"))
    )


def device_parts(messages: DataFrame, *keys: str) -> DataFrame:
    """Bounds of ``readings`` and ``xtime`` per device, apart for each value of further ``keys``. Those of
    different messages are put together by ``merge_device_parts``."""
    return messages.groupBy(*keys, "DeviceID").agg(
        F.max("readings").alias("most_readings"),
        F.min("readings").alias("least_readings"),
        F.max("xtime").alias("most_xtime"),
        F.min("xtime").alias("least_xtime"),
    )


def merge_device_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("DeviceID").agg(
        *[F.max(c).alias(c) for c in ("most_readings", "most_xtime")],
        *[F.min(c).alias(c) for c in ("least_readings", "least_xtime")],
    )


def dropped_devices(messages: DataFrame) -> DataFrame:
    """Devices that lose some (reduced) or all (dropped) messages in the clean-up."""
    return dropped_of_devices(device_parts(messages))


def dropped_of_devices(devices: DataFrame) -> DataFrame:
    """``dropped_devices`` from the bounds of each device."""
    flags = devices.select(
        "DeviceID",
        (F.col("most_readings") == 8).alias("has_8_readings"),
        (F.col("least_readings") == 8).alias("has_no_non_8_readings"),
        (F.col("most_xtime") == 4).alias("has_4_xtime"),
        (F.col("least_xtime") == 4).alias("has_no_non_4_xtime"),
    )
    untouched = (
        F.col("has_8_readings")
        & F.col("has_no_non_8_readings")
        & F.col("has_4_xtime")
        & F.col("has_no_non_4_xtime")
    )
    return flags.withColumn("dropped", ~F.col("has_8_readings") | ~F.col("has_4_xtime")).filter(
        ~untouched
    )
