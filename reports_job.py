"""Collect messages into the history, and write the reports of a period, as a ``spark-submit`` job.

    spark-submit reports_job.py collect --exports PATH... --history ROOT --namespace NAME
    spark-submit reports_job.py collect --jdbc-url URL --table NAME --history ROOT --namespace NAME
    spark-submit reports_job.py report --history ROOT --namespace NAME --output ROOT

All take ``--start-date`` and ``--end-date`` (default: yesterday and today) and ``--on-error raise|null``.
A database's user and password are taken from the environment variables that ``--user-variable`` and
``--password-variable`` name. ``report`` takes ``--rebuild``.
"""

import argparse
import os

from pyspark.sql import SparkSession, functions as F

from metertide.functions.time import previous_day, run_name
from metertide.plans.incremental import write_history_reports
from metertide.plans.reports import (
    collect_from_database,
    collect_from_exports,
    export_reports,
)
from metertide.sinks.files import append_history
from metertide.sources.jdbc import Connection


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    yesterday, today = previous_day()
    parser = argparse.ArgumentParser(description="Meter reports")
    commands = parser.add_subparsers(dest="command", required=True)
    collect = commands.add_parser("collect", help="add messages to the history")
    source = collect.add_mutually_exclusive_group(required=True)
    source.add_argument("--exports", nargs="+")
    source.add_argument("--jdbc-url")
    collect.add_argument("--table", help="of decoded JSON documents, with --jdbc-url")
    collect.add_argument("--time-column", default="ts")
    collect.add_argument("--buckets", type=int, help="store in so many buckets by row, for overlapping runs")
    collect.add_argument("--driver", help="class of the JDBC driver")
    collect.add_argument("--user-variable", default="DATABASE_USER")
    collect.add_argument("--password-variable", default="DATABASE_PASSWORD")
    report = commands.add_parser("report", help="write the reports of a period")
    report.add_argument("--output", required=True)
    report.add_argument("--rebuild", action="store_true")
    for command in (collect, report):
        command.add_argument("--history", required=True)
        command.add_argument("--namespace", required=True)
        command.add_argument("--start-date", default=yesterday)
        command.add_argument("--end-date", default=today)
        command.add_argument("--on-error", choices=["raise", "null"], default="raise")
    options = parser.parse_args(arguments)
    if options.command == "collect" and options.jdbc_url and not options.table:
        parser.error("--jdbc-url needs --table")
    return options


def collected(spark: SparkSession, options: argparse.Namespace):
    if options.exports:
        return collect_from_exports(spark, options.exports, options.on_error)
    connection = Connection(
        options.jdbc_url,
        os.environ.get(options.user_variable),
        os.environ.get(options.password_variable),
        {"driver": options.driver} if options.driver else {},
    )
    return collect_from_database(
        spark,
        connection,
        options.table,
        options.time_column,
        options.start_date,
        options.end_date,
        options.on_error,
    )


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    period = (F.lit(day).cast("date") for day in (options.start_date, options.end_date))
    name = spark.range(1).select(run_name(F.lit(options.namespace), *period)).first()[0]
    if options.command == "collect":
        messages = collected(spark, options)
        append_history(
            messages, options.history, options.namespace, name, options.on_error, options.buckets
        )
        return
    reports = write_history_reports(
        spark,
        options.history,
        options.output,
        options.namespace,
        options.start_date,
        options.end_date,
        options.on_error,
        rebuild=options.rebuild,
    )
    export_reports(reports, f"{options.output}/{name}/csv")


if __name__ == "__main__":
    run(SparkSession.builder.appName("meter-reports").getOrCreate(), parse())
