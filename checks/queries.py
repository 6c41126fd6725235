"""One query per operator group, each over whole tables."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixtures import (
    END,
    FIRST_EXPORT_END,
    FIXED_TIME,
    SECOND_EXPORT_START,
    START,
    decoded_messages,
    devices,
    messages,
    organisation_documents,
    table,
)
from checks.oracle import REPORT_CONTENTS
from metertide.functions.time import compact_midnight, run_name
from metertide.operators.flows import daily_flows, daily_flows_of_messages, unpack_flows
from metertide.operators.messages import (
    SENT,
    clean_messages,
    distinct_messages,
    dropped_devices,
    filter_messages,
    in_period,
    initial_device_count,
)
from metertide.operators.ordering import with_row_index
from metertide.operators.runs import consecutive_flow_state, find_leaks, flow_runs
from metertide.operators.stats import dropped_device_stats, leak_stats, usage_stats
from metertide.operators.stretches import (
    leaks_of_stretches,
    number_stretches,
    stretch_days,
    stretch_runs,
)
from metertide.operators.tables import (
    append_indexed_rows,
    append_rows,
    delete_where,
    edit_by_index,
    update_where,
)
from metertide.operators.usage import device_usage
from metertide.plans.incremental import write_history_reports
from metertide.plans.reports import (
    build_reports,
    collect_from_exports,
)
from metertide.schemas import DEVICE, FLOW_COLUMNS
from metertide.sinks.files import append_history, write_csv
from metertide.sources.documents import flatten_decoded, organisation_names
from metertide.sources.files import read_messages, read_with_repeated_headers
from metertide.sources.history import current_runs, read_distinct, runs_by_date
from metertide.workspace import materialize, new_path

#: For the size of the given tables; see ``append_history``.
BUCKETS = 8

Query = Callable[[SparkSession, str], DataFrame]


def filtered(spark, sf_dir):
    return filter_messages(messages(spark, sf_dir), START, END)


def days(spark, sf_dir):
    return daily_flows_of_messages(clean_messages(filtered(spark, sf_dir)))


def usage(spark, sf_dir):
    return device_usage(days(spark, sf_dir))


def leaks(spark, sf_dir):
    return find_leaks(flow_runs(days(spark, sf_dir)))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of means differ in the last digits from run to run."""
    return df.withColumns({name: F.round(name, 6) for name in columns})


def messages_scan(spark, sf_dir):
    """Export to CSV, then scan the files."""
    path = new_path(spark, "export")
    write_csv(messages(spark, sf_dir), path)
    return read_messages(spark, path)


def exports(spark, sf_dir):
    """All messages as two parts that overlap."""
    everything = messages(spark, sf_dir)
    return (
        everything.filter(F.col("Timestamp") < FIRST_EXPORT_END),
        everything.filter(F.col("Timestamp") >= SECOND_EXPORT_START),
    )


def messages_union_distinct(spark, sf_dir):
    """Two overlapping exports, collected to one table without duplicates."""
    paths = [new_path(spark, "first-export"), new_path(spark, "second-export")]
    for part, path in zip(exports(spark, sf_dir), paths, strict=True):
        write_csv(part, path)
    return collect_from_exports(spark, paths)


def repeated_header_load(spark, sf_dir):
    """Devices as CSV files in which the header comes again before every thousandth id."""
    names = DEVICE.fieldNames()
    row = F.struct(*[F.col(name).cast("string").alias(name) for name in names])
    header = F.struct(*[F.lit(name).alias(name) for name in names])
    lines = F.when(F.col("id") % 1000 == 0, F.array(header, row)).otherwise(F.array(row))
    path = new_path(spark, "glued")
    write_csv(devices(spark, sf_dir).select(F.inline(lines)), path)
    return read_with_repeated_headers(spark, path, DEVICE)


def consecutive_flow(spark, sf_dir):
    return consecutive_flow_state(materialize(days(spark, sf_dir), "day-flows"))


def usage_summary(spark, sf_dir):
    stats = usage_stats(materialize(usage(spark, sf_dir), "usage"))
    return rounded(stats, "value")


def dropped_summary(spark, sf_dir):
    columns = ["DeviceID", "Timestamp", "msgType", "readings", "xtime", *FLOW_COLUMNS]
    kept = materialize(filtered(spark, sf_dir).select(columns), "filtered-messages")
    used = device_usage(daily_flows_of_messages(clean_messages(kept)))
    return dropped_device_stats(dropped_devices(kept), used, initial_device_count(kept))


def by_week(spark, sf_dir):
    """The device-days cut into weeks, and the runs of each."""
    week = F.trunc(F.col("date"), "week").cast("string")
    cut = materialize(stretch_days(days(spark, sf_dir), week), "stretch-days")
    return cut, materialize(stretch_runs(cut), "stretch-runs")


def history_reports(spark, sf_dir):
    """As ``reports_all``, from a history of two overlapping runs, of which the second came late: the
    reports are made before and after it, so the second time only its dates are read."""
    root = new_path(spark, "history")
    first, second = exports(spark, sf_dir)
    append_history(first, f"{root}/messages", "ns", "first")
    write_history_reports(spark, f"{root}/messages", f"{root}/reports", "ns", START, END)
    append_history(second, f"{root}/messages", "ns", "second")
    return contents(write_history_reports(spark, f"{root}/messages", f"{root}/reports", "ns", START, END))


def bucketed_distinct(spark, sf_dir):
    """The messages of the period without duplicates, from two overlapping runs in buckets by row."""
    root = new_path(spark, "history")
    for run, part in zip(("first", "second"), exports(spark, sf_dir), strict=True):
        append_history(part, root, "ns", run, buckets=BUCKETS)
    held = runs_by_date(current_runs(spark, root, "ns"), START, END)
    return in_period(read_distinct(spark, root, held), START, END).drop(SENT)


def reports_all(spark, sf_dir):
    """How many rows each report has, and a sum over its contents."""
    return contents(build_reports(messages(spark, sf_dir), START, END))


def contents(reports):
    sums = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(F.expr(REPORT_CONTENTS[name])).cast("bigint").alias("content"),
        ).select(F.lit(name).alias("report"), "row_count", "content")
        for name, df in reports.items()
    ]
    return reduce(DataFrame.unionByName, sums)


def device_select(spark, sf_dir):
    return devices(spark, sf_dir).select("devicename", "databytes", "datatime", "devicetype_id")


def device_update(spark, sf_dir):
    return update_where(devices(spark, sf_dir), F.col("id") == 5, {"devicename": F.lit("edited")})


def device_delete(spark, sf_dir):
    return delete_where(devices(spark, sf_dir), F.col("id") == 6)


def device_append(spark, sf_dir):
    time = F.lit(FIXED_TIME).cast("timestamp_ntz")
    new = [(5, "9982", 12, None, 1, 15, 1), (6, "1232", 14, None, 1, 15, 2)]
    appended = append_rows(devices(spark, sf_dir), new)
    stamped = appended.withColumn("datatime", F.coalesce("datatime", time))
    return materialize(stamped, "device-next")


def indexed_edit(spark, sf_dir):
    """Customers by key with a row index; suppliers' names replace names, and two rows follow."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("col1"), F.col("c_mktsegment").alias("col2"), "c_custkey"
    )
    indexed = with_row_index(customers, [F.col("c_custkey")]).drop("c_custkey")
    edits = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("index"), F.col("s_name").alias("col2")
    )
    return append_indexed_rows(edit_by_index(indexed, edits, "col2"), [("1-4", "2-4"), ("1-5", "2-5")])


def run_dates(spark, sf_dir):
    """For each date with events, the collection run that would have fetched it."""
    today = F.col("run_day")
    return (
        table(spark, sf_dir, "events")
        .select(F.date_add(F.to_date("ts"), 1).alias("run_day"))
        .distinct()
        .select(
            "run_day",
            compact_midnight(F.date_sub(today, 1)).alias("date_from"),
            compact_midnight(today).alias("date_to"),
            run_name(F.lit("meters"), F.date_sub(today, 1), today).alias("run"),
        )
    )


QUERIES: dict[str, Query] = {
    "messages_scan": messages_scan,
    "messages_union_distinct": messages_union_distinct,
    "decoded_json_flatten": lambda s, d: flatten_decoded(decoded_messages(s, d)),
    "organisations_explode": lambda s, d: organisation_names(organisation_documents(s, d)),
    "filter_dates": filtered,
    "initial_device_count": lambda s, d: initial_device_count(filtered(s, d)),
    "clean_messages": lambda s, d: clean_messages(filtered(s, d)),
    "flow_rows": lambda s, d: unpack_flows(clean_messages(filtered(s, d))),
    "day_flows": lambda s, d: daily_flows(unpack_flows(clean_messages(filtered(s, d)))),
    "day_flows_of_messages": days,
    "consecutive_flow_state": consecutive_flow,
    "leaks": leaks,
    "leak_stats": lambda s, d: rounded(leak_stats(leaks(s, d)), "value"),
    "usage": lambda s, d: rounded(usage(s, d), "avg_daily_flow"),
    "usage_stats": usage_summary,
    "dropped_devices": lambda s, d: dropped_devices(filtered(s, d)),
    "dropped_device_stats": dropped_summary,
    "stretch_flow_state": lambda s, d: number_stretches(*by_week(s, d)),
    "stretch_leaks": lambda s, d: leaks_of_stretches(by_week(s, d)[1]),
    "reports_all": reports_all,
    "history_reports": history_reports,
    "bucketed_distinct": bucketed_distinct,
    "device_select": device_select,
    "device_update": device_update,
    "device_delete": device_delete,
    "device_append": device_append,
    "indexed_edit": indexed_edit,
    "repeated_header_load": repeated_header_load,
    "run_dates": run_dates,
}
