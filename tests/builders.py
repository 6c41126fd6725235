"""Small hand-written frames."""

from datetime import date

from metertide.schemas import DAY_FLOWS, MESSAGES

START_DAY = date(2024, 1, 1)


def message(
    device, sent="2024-01-05T10:00:00", flows=(1, 2, 3, 4, 5, 6, 7, 8), readings=8, kind=1, xtime=4, seq=0
):
    known = [flow for flow in flows if flow is not None]
    return (
        device,
        sent,
        0,
        "raw",
        kind,
        seq,
        readings,
        0,
        *flows,
        xtime,
        max(known, default=None),
        min(known, default=None),
    )


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), MESSAGES)


def day(device, number, least, total=100, clipped=False):
    """One device-day: the date by its number in January, and the least flow."""
    return (device, START_DAY.replace(day=number), total, least, clipped)


def days(spark, *rows):
    return spark.createDataFrame(list(rows), DAY_FLOWS)
