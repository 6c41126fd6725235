"""Reports of a history that follow their input date by date and month by month.

Messages are read once per message date. From those of a date, whatever runs they came in, partial
device-days and bounds per device are kept; a late or replaced run rebuilds its dates and no others. The
device-days of a period are put together from its dates, month by month, as a date's messages reach
back to the date before. Of each month the numbered days and the runs are kept, so a new day costs its
own month; earlier months only give their runs.

What is kept does not depend on a period, except for the months that a period cuts, and is shared by all.
"""

import hashlib
from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from metertide.functions.time import midnight
from metertide.operators.flows import day_parts, merge_day_parts
from metertide.operators.messages import (
    MESSAGE_DATE,
    SENT,
    clean_messages,
    device_parts,
    dropped_of_devices,
    filter_messages,
    merge_device_parts,
)
from metertide.operators.stats import dropped_device_stats, leak_stats, usage_stats
from metertide.operators.stretches import (
    STRETCH,
    leaks_of_stretches,
    month_of,
    number_stretches,
    stretch_days,
    stretch_runs,
)
from metertide.operators.usage import device_usage
from metertide.schemas import (
    DAY_FLOWS,
    DAY_PARTS,
    DEVICE_PARTS,
    MESSAGES,
    STRETCH_DAYS,
    STRETCH_RUNS,
)
from metertide.sinks.files import write_once
from metertide.sinks.parts import PartStore
from metertide.sources.history import (
    Run,
    current_runs,
    identity_of,
    period_identity,
    read_dates,
    read_distinct,
    runs_by_date,
)
from metertide.workspace import temporary_tables

#: Kept tables are made anew if this changes.
FORMAT = "1"


def _digest(*notes: str) -> str:
    return hashlib.sha256("\n".join(notes).encode()).hexdigest()[:16]


class HistoryDays:
    """Device-days and devices of a period of a history, kept by message date under ``store``."""

    def __init__(
        self,
        spark: SparkSession,
        history: str,
        store: str,
        namespace: str,
        start: str,
        end: str,
        on_error: str = "raise",
    ) -> None:
        self.spark, self.history, self.on_error = spark, history, on_error
        self.start, self.end = start, end
        runs = current_runs(spark, history, namespace)
        self.identity = period_identity(runs, start, end)
        self.runs = runs_by_date(runs, start, end)
        #: Of the last date only the first instant counts, so it is no whole date and is not kept.
        self.instant = {day: held for day, held in self.runs.items() if day == end}
        self.wanted = {
            day: _digest(FORMAT, on_error, identity_of(held))
            for day, held in self.runs.items()
            if day != end
        }
        root = f"{store}/namespace={namespace}"
        self.days = PartStore(
            spark, f"{root}/dates", MESSAGE_DATE, {"flows": DAY_PARTS, "devices": DEVICE_PARTS}
        )
        self.months = PartStore(
            spark, f"{root}/months", STRETCH, {"days": STRETCH_DAYS, "runs": STRETCH_RUNS}
        )

    def messages(self, days: Mapping[str, list[Run]]) -> DataFrame:
        """The distinct messages that runs hold of given dates, within the period."""
        return filter_messages(
            read_dates(self.spark, self.history, dict(days)), self.start, self.end, self.on_error
        )

    def refresh_dates(self, rebuild: bool = False) -> list[str]:
        """Bring the kept dates up to date; returns those that were read."""

        def make(days: list[str]) -> dict[str, DataFrame]:
            held = read_distinct(self.spark, self.history, {d: self.runs[d] for d in days})
            messages = held.withColumn(MESSAGE_DATE, F.col(SENT).cast("date").cast("string"))
            return {
                "flows": day_parts(clean_messages(messages, self.on_error, MESSAGE_DATE), MESSAGE_DATE),
                "devices": device_parts(messages, MESSAGE_DATE),
            }

        with temporary_tables(self.spark):
            return self.days.refresh(self.wanted, make, rebuild)

    def _last_instant(self) -> DataFrame:
        return self.messages(self.instant).filter(F.col(SENT) == midnight(self.end))

    def day_flows(self, message_dates: Mapping[str, str] | None = None, last: bool = True) -> DataFrame:
        """Device-days of the period, or of the given message dates."""
        wanted = self.wanted if message_dates is None else message_dates
        parts = self.days.read("flows", wanted).drop(MESSAGE_DATE)
        if last and self.instant:
            parts = parts.unionByName(day_parts(clean_messages(self._last_instant(), self.on_error)))
        return merge_day_parts(parts)

    def devices(self) -> DataFrame:
        """Bounds of all devices with messages in the period."""
        parts = self.days.read("devices", self.wanted).drop(MESSAGE_DATE)
        if self.instant:
            parts = parts.unionByName(device_parts(self._last_instant()))
        return merge_device_parts(parts)

    def month_sources(self) -> dict[str, list[str]]:
        """For each month with device-days the message dates they come from."""
        sources: dict[str, list[str]] = {}
        for day in self.runs:
            before = str(date.fromisoformat(day) - timedelta(days=1))
            for month in {day[:7], before[:7]}:
                sources.setdefault(month, []).append(day)
        return sources

    def wanted_months(self) -> dict[str, str]:
        """Each month with the identity of its message dates."""
        known = self.wanted | {
            day: _digest(FORMAT, "instant", self.on_error, identity_of(held))
            for day, held in self.instant.items()
        }
        return {
            month: _digest(FORMAT, *(f"{day}:{known[day]}" for day in days))
            for month, days in sorted(self.month_sources().items())
        }

    def refresh_months(self, rebuild: bool = False) -> list[str]:
        """Bring the kept months up to date; returns those that were numbered."""
        sources = self.month_sources()

        def make(months: list[str]) -> dict[str, DataFrame]:
            needed = {day for month in months for day in sources[month]}
            flows = self.day_flows(
                {day: i for day, i in self.wanted.items() if day in needed}, self.end in needed
            )
            mine = flows.filter(month_of(F.col("date")).isin(months))
            days = stretch_days(mine, month_of(F.col("date")))
            return {"days": days, "runs": stretch_runs(days)}

        return self.months.refresh(self.wanted_months(), make, rebuild)

    def month_days(self) -> DataFrame:
        return self.months.read("days", self.wanted_months())

    def month_runs(self) -> DataFrame:
        return self.months.read("runs", self.wanted_months())

    def tidy(self) -> None:
        """Remove what is kept of other inputs, and of other periods."""
        self.days.tidy(self.wanted)
        self.months.tidy(self.wanted_months())


def write_history_reports(
    spark: SparkSession,
    history: str,
    root: str,
    namespace: str,
    start: str,
    end: str,
    on_error: str = "raise",
    rebuild: bool = False,
) -> dict[str, DataFrame]:
    """The tables of ``write_reports`` for a period of a history, from what is kept by date and month
    under ``root/kept``.

    Runs without messages in the period change nothing, and a run with some reads its own dates only.
    ``filtered_messages`` is not written; it is the frame that gives them.
    """
    days = HistoryDays(spark, history, f"{root}/kept", namespace, start, end, on_error)
    folder = f"{root}/{namespace}_{start}_{end}/{on_error}-{days.identity}"

    def keep(name, build):
        return write_once(spark, build, f"{folder}/{name}", rebuild)

    days.refresh_dates(rebuild)
    days.refresh_months(rebuild)
    with temporary_tables(spark):
        devices = keep("devices", days.devices)
        initial = keep(
            "initial_device_count", lambda: devices.agg(F.count(F.lit(1)).alias("num_devices"))
        )
        columns = DAY_FLOWS.fieldNames()
        day_flows = keep("day_flows", lambda: days.month_days().select(columns))
        leaks = keep("leakage", lambda: leaks_of_stretches(days.month_runs()))
        usage = keep("usage", lambda: device_usage(day_flows))
        dropped = keep("dropped_devices", lambda: dropped_of_devices(devices))
        return {
            "filtered_messages": days.messages(days.runs).select(MESSAGES.fieldNames()),
            "initial_device_count": initial,
            "day_flows": day_flows,
            "consecutive_flow": keep(
                "consecutive_flow", lambda: number_stretches(days.month_days(), days.month_runs())
            ),
            "leakage": leaks,
            "leakage_stats": keep("leakage_stats", lambda: leak_stats(leaks)),
            "usage": usage,
            "usage_stats": keep("usage_stats", lambda: usage_stats(usage)),
            "dropped_devices": dropped,
            "dropped_devices_stats": keep(
                "dropped_devices_stats", lambda: dropped_device_stats(dropped, usage, initial)
            ),
        }
