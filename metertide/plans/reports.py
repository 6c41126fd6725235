"""Usage, leakage and dropped-device reports over one period."""

import json
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from metertide.operators.flows import daily_flows_of_messages
from metertide.operators.messages import (
    MESSAGE_DATE,
    clean_messages,
    distinct_messages,
    dropped_devices,
    filter_messages,
    initial_device_count,
    with_sent,
)
from metertide.operators.runs import find_leaks, number_runs, stored_runs
from metertide.operators.stats import dropped_device_stats, leak_stats, usage_stats
from metertide.operators.usage import device_usage
from metertide.schemas import MESSAGES
from metertide.sinks.files import write_csv, write_if_any, write_once, write_scalar
from metertide.sinks.jdbc import append_to_table
from metertide.sources.documents import flatten_decoded
from metertide.sources.files import read_messages, read_with_repeated_headers
from metertide.sources.history import FIRST_SENT, Run, period_identity
from metertide.sources.jdbc import Connection, day_predicates, read_period, read_table
from metertide.versions import read_text
from metertide.workspace import materialize, temporary_tables

Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def collect_from_database(
    spark: SparkSession,
    connection: Connection,
    table: str,
    time_column: str,
    start: str,
    end: str,
    on_error: str = "raise",
    slices: int | None = None,
    sample: str = "",
) -> DataFrame:
    """Messages of a period from a database table of decoded JSON documents, one day per connection.

    ``table`` holds ``payload`` and the time, which is called ``ts`` from here on. With ``slices`` the
    period, be it a single day, is read over so many connections of near equal numbers of rows instead;
    ``sample`` is as in ``histogram_sql``.
    """
    if slices is None:
        rows = read_table(spark, connection, table, day_predicates(time_column, start, end))
    else:
        rows = read_period(spark, connection, table, time_column, start, end, slices, sample)
    return flatten_decoded(rows.withColumnRenamed(time_column, "ts"), on_error)


def collect_from_exports(spark: SparkSession, paths, on_error: str = "raise") -> DataFrame:
    """Messages from all export files, which may overlap."""
    return distinct_messages(read_messages(spark, paths, on_error))


def load_table_from_files(
    spark: SparkSession,
    paths,
    schema: StructType,
    connection: Connection,
    table: str,
    columns: Sequence[str] | None = None,
    on_error: str = "raise",
) -> None:
    """Append files in which the header may come again between rows to a database table."""
    rows = read_with_repeated_headers(spark, paths, schema, on_error)
    append_to_table(rows, connection, table, columns)


# Final order of the reports. Later keys keep rows with the same first key apart, so that many
# equal values do not end up in one range partition.
def in_final_order(name: str, report: DataFrame) -> DataFrame:
    """A report as its files list it: sorted, or as it is if its rows have no order.

    A table that is written and read again has lost its order, so this comes right before the files.
    """
    if name == "day_flows":
        return report.orderBy(F.desc("date"), "device_id")
    if name == "consecutive_flow":
        return report.orderBy(F.desc("device_id"), F.desc("date"))
    if name == "leakage":
        return report.orderBy(F.desc("leak_amount_litres"), "device_id", "leak_start_date")
    if name == "usage":
        return report.orderBy(F.desc("avg_daily_flow"), "device_id")
    return report


def _materialize(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return materialize(build(), name)


def build_reports(
    messages: DataFrame, start: str, end: str, keep: Keep = _materialize, on_error: str = "raise"
) -> dict[str, DataFrame]:
    """All tables of the reports, by name, in no order.

    Each table goes through ``keep``, which writes it and returns the written table: the export is
    read once, its times are parsed once, and later tables start from the small ones before them.
    Numbering and leaks both start from the days in buckets by device.
    """
    filtered = keep(
        "filtered_messages",
        lambda: filter_messages(with_sent(messages, on_error), start, end, on_error),
    )
    initial = keep("initial_device_count", lambda: initial_device_count(filtered))
    day_flows = keep(
        "day_flows", lambda: daily_flows_of_messages(clean_messages(filtered, on_error))
    )
    by_device = cache(lambda: stored_runs(day_flows))
    states = keep("consecutive_flow", lambda: number_runs(by_device()))
    leaks = keep("leakage", lambda: find_leaks(by_device()))
    usage = keep("usage", lambda: device_usage(day_flows))
    dropped = keep("dropped_devices", lambda: dropped_devices(filtered))
    return {
        "filtered_messages": filtered.select(MESSAGES.fieldNames()),
        "initial_device_count": initial,
        "day_flows": day_flows,
        "consecutive_flow": states,
        "leakage": leaks,
        "leakage_stats": keep("leakage_stats", lambda: leak_stats(leaks)),
        "usage": usage,
        "usage_stats": keep("usage_stats", lambda: usage_stats(usage)),
        "dropped_devices": dropped,
        "dropped_devices_stats": keep(
            "dropped_devices_stats", lambda: dropped_device_stats(dropped, usage, initial)
        ),
    }


def input_identity(messages: DataFrame, start: str, end: str) -> str:
    """What a frame of the history holds of a period, by the names of its files; nothing is read."""
    held: dict[str, set[str]] = {}
    for file in messages.inputFiles():
        version, day = file.rsplit("/", 2)[:2]
        held.setdefault(version, set()).add(day.removeprefix(f"{MESSAGE_DATE}="))
    runs = []
    for path, days in held.items():
        firsts = json.loads(read_text(messages.sparkSession, f"{path}/{FIRST_SENT}"))
        names = dict(part.split("=", 1) for part in path.split("/")[-3:])
        runs.append(Run(**names, path=path, dates={d: t for d, t in firsts.items() if d in days}))
    return period_identity(runs, start, end)


def write_reports(
    messages: DataFrame,
    root: str,
    namespace: str,
    start: str,
    end: str,
    on_error: str = "raise",
    identity: str | None = None,
    rebuild: bool = False,
) -> dict[str, DataFrame]:
    """Write all tables of a period under ``root`` and return them.

    The folder names the namespace, the period, ``on_error`` and what the input holds of the period, so
    tables of different inputs never meet, and messages of other periods change nothing. Finished tables of the same input are not computed again, unless
    ``rebuild`` asks for it, and a run that was cut short goes on where it stopped. For a frame that is
    not from ``read_history``, ``identity`` says what it is made of.
    """
    spark = messages.sparkSession
    if identity is None:
        if "version" not in messages.columns:
            raise ValueError("say by identity what messages from outside the history are made of")
        identity = input_identity(messages, start, end)
    folder = f"{root}/{namespace}_{start}_{end}/{on_error}-{identity}"

    def keep(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return write_once(spark, build, f"{folder}/{name}", rebuild)

    with temporary_tables(spark):
        return build_reports(messages, start, end, keep, on_error)


# The files a report reader gets.
EXPORTED = [
    "day_flows",
    "consecutive_flow",
    "leakage",
    "leakage_stats",
    "usage",
    "usage_stats",
    "dropped_devices",
    "dropped_devices_stats",
]


def export_reports(reports: dict[str, DataFrame], root: str) -> list[str]:
    """The written reports as CSV, one folder each; the dropped statistics only if there are any.

    Returns the names exported.
    """
    exported = []
    for name in EXPORTED:
        files = f"{root}/{name}.csv"
        if name == "dropped_devices_stats":
            if not write_if_any(reports[name], files, mode="overwrite"):
                continue
        else:
            write_csv(in_final_order(name, reports[name]), files, mode="overwrite")
        exported.append(name)
    write_scalar(
        reports["initial_device_count"], f"{root}/initial_device_count.txt", mode="overwrite"
    )
    return exported
