from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

# The text format of a message timestamp.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z"
READINGS_PER_MESSAGE = 8


def parse_timestamp(text: Column, on_error: str = "raise") -> Column:
    """Text to ``timestamp_ntz``, only in the form ``2024-01-31T23:59:59``.

    A cast parses faster than a format pattern but also takes shorter and zoned texts, so it is
    used behind a check of the form. All other texts go to the pattern, which raises (under Spark's
    default ANSI mode), or become null with ``on_error="null"``.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be 'raise' or 'null', not {on_error!r}")
    well_formed = text.rlike(TIMESTAMP_PATTERN)
    if on_error == "null":
        return F.when(well_formed, text.try_cast("timestamp_ntz"))
    return F.when(well_formed, text.cast("timestamp_ntz")).otherwise(
        F.to_timestamp_ntz(text, F.lit(TIMESTAMP_FORMAT))
    )


def timestamp_text(timestamp: Column) -> Column:
    """``timestamp_ntz`` to message text, whole seconds. No time zone takes part."""
    return F.replace(F.substring(timestamp.cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def midnight(day: str | date) -> Column:
    """A date parameter as the first instant of that day."""
    if isinstance(day, str):
        day = datetime.strptime(day, "%Y-%m-%d")
    return F.lit(f"{day:%Y-%m-%d}").cast("timestamp_ntz")


def last_reading_hour(timestamp: Column) -> Column:
    """Hour in which the last reading of a message began, relative to the message's date: -1..23.

    A message closes its last reading. Readings are not aligned to the hour, so each one belongs
    to the hour it overlaps most: before half past, that is one hour further back.
    """
    return F.hour(timestamp) - F.when(F.minute(timestamp) < 30, 1).otherwise(0)


def reading_timestamp(timestamp: Column, flow_id: Column) -> Column:
    """Start of reading ``flow_id`` (1..8), not floored to the hour."""
    hours_back = (
        F.lit(READINGS_PER_MESSAGE) - flow_id + F.when(F.minute(timestamp) < 30, 1).otherwise(0)
    )
    return timestamp - F.expr("INTERVAL '1' HOUR") * hours_back


def compact_midnight(day: Column) -> Column:
    """``2024-01-31`` to ``20240131000000``, the form an export request takes."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("000000"))


def run_name(namespace: Column, first_day: Column, last_day: Column) -> Column:
    """``namespace_first_last``, the name of one collection run."""
    return F.concat_ws("_", namespace, first_day.cast("string"), last_day.cast("string"))


def previous_day(today: date | None = None) -> tuple[str, str]:
    """Default period of a run: yesterday up to today."""
    today = today or date.today()
    return str(today - timedelta(days=1)), str(today)
