"""The message history: collection runs in their current versions."""

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from metertide.operators.messages import MESSAGE_DATE, ROW_HASH, SENT, distinct_messages
from metertide.schemas import MESSAGES
from metertide.versions import POINTER, current_version, matching, qualified, read_text
from metertide.workspace import new_table

#: A small file of each version: the first time of each of its dates.
FIRST_SENT = "_FIRST_SENT"
#: A small file of a version in buckets: how many there are.
BUCKETS = "_BUCKETS"
MIDNIGHT = " 00:00:00"
#: Folders that one statement adds to a catalog table.
FOLDERS_AT_ONCE = 1000


@dataclass(frozen=True)
class Run:
    """A collection run in its current version. ``dates`` holds the first time of each date, ``buckets`` how
    many buckets by row each date lies in, if it lies in any."""

    namespace: str
    run: str
    version: str
    path: str
    dates: dict[str, str]
    buckets: int | None = None

    def dates_in(self, start: str, end: str) -> list[str]:
        """Dates with messages from the first instant of ``start`` to the first instant of ``end``."""
        return sorted(
            day
            for day, first in self.dates.items()
            if start <= day < end or day == end and first == end + MIDNIGHT
        )


def current_runs(spark: SparkSession, root: str, namespace: str | None = None) -> list[Run]:
    """All runs, or those of a namespace, found by their small files alone."""
    runs = []
    for pointer in matching(spark, f"{root}/namespace={namespace or '*'}/run=*/{POINTER}"):
        folder = pointer.removesuffix(f"/{POINTER}")
        version = current_version(spark, folder)
        path = f"{folder}/version={version}"
        named = dict(part.split("=", 1) for part in folder.split("/")[-2:])
        dates = json.loads(read_text(spark, f"{path}/{FIRST_SENT}"))
        buckets = read_text(spark, f"{path}/{BUCKETS}")
        buckets = None if buckets is None else int(buckets)
        runs.append(Run(named["namespace"], named["run"], version, path, dates, buckets))
    return runs


def runs_by_date(runs: Sequence[Run], start: str, end: str) -> dict[str, list[Run]]:
    """The dates of a period that have messages, with the runs that hold them."""
    found: dict[str, list[Run]] = {}
    for run in runs:
        for day in run.dates_in(start, end):
            found.setdefault(day, []).append(run)
    return dict(sorted(found.items()))


def identity_of(runs: Sequence[Run], *notes: str) -> str:
    """What a result is made of: runs in their versions, and notes. Paths do not count."""
    names = sorted(f"{run.namespace}|{run.run}|{run.version}" for run in runs)
    return hashlib.sha256("\n".join([*names, *notes]).encode()).hexdigest()[:16]


def period_identity(runs: Sequence[Run], start: str, end: str) -> str:
    """The identity of the messages of a period; runs without messages in it do not count."""
    days = runs_by_date(runs, start, end)
    return identity_of([], *(f"{day}:{identity_of(held)}" for day, held in days.items()))


#: The folders of the history, outermost first.
FOLDERS = ("namespace", "run", "version", MESSAGE_DATE)


def history_schema() -> StructType:
    schema = StructType(list(MESSAGES.fields)).add(SENT, "timestamp_ntz")
    for name in FOLDERS[:-1]:
        schema = schema.add(name, "string")
    return schema.add(MESSAGE_DATE, "date")


def read_dates(spark: SparkSession, root: str, days: dict[str, list[Run]]) -> DataFrame:
    """The messages that runs hold of given dates; no other folder is listed or read."""
    paths = [f"{run.path}/{MESSAGE_DATE}={day}" for day, runs in days.items() for run in runs]
    if not paths:
        return spark.createDataFrame([], history_schema())
    return spark.read.schema(history_schema()).option("basePath", root).parquet(*paths)


def read_distinct(spark: SparkSession, root: str, days: dict[str, list[Run]]) -> DataFrame:
    """The distinct messages that runs hold of given dates, by ``distinct_messages``.

    If all runs lie in the same number of buckets, copies of a row lie in the same bucket of each, and one
    task reads a bucket of all: nothing is shuffled, by this or by what groups by the whole row after it.
    Otherwise, as with runs from before there were buckets, copies meet by a shuffle; the rows are the same.

    A history in buckets is read by way of a catalog table with the given folders and no others. Its name
    lasts to the end of the enclosing ``temporary_tables`` block, and must while the frame is used; its
    files are the history's and stay.
    """
    counts = {run.buckets for runs in days.values() for run in runs}
    if len(counts) != 1 or counts == {None}:
        return distinct_messages(read_dates(spark, root, days))
    (buckets,) = counts
    table, schema = new_table(), history_schema()
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    columns.insert(len(schema) - len(FOLDERS), f"{ROW_HASH} bigint")
    spark.sql(
        f"CREATE TABLE {table} ({', '.join(columns)}) USING parquet PARTITIONED BY ({', '.join(FOLDERS)}) "
        f"CLUSTERED BY ({ROW_HASH}) INTO {buckets} BUCKETS LOCATION '{qualified(spark, root)}'"
    )
    folders = [
        f"PARTITION (namespace='{run.namespace}', run='{run.run}', version='{run.version}', "
        f"{MESSAGE_DATE}='{day}') LOCATION '{run.path}/{MESSAGE_DATE}={day}'"
        for day, runs in days.items()
        for run in runs
    ]
    for begin in range(0, len(folders), FOLDERS_AT_ONCE):
        spark.sql(f"ALTER TABLE {table} ADD {' '.join(folders[begin : begin + FOLDERS_AT_ONCE])}")
    return distinct_messages(spark.table(table))


def read_history(spark: SparkSession, root: str, namespace: str | None = None) -> DataFrame:
    """Accumulated messages of all current runs with their time as ``sent`` and the ``namespace``, ``run``,
    ``version`` and ``message_date`` folders they lie in.

    Pass it to ``filter_messages``, which skips the folders outside its period.
    """
    paths = [run.path for run in current_runs(spark, root, namespace)]
    if not paths:
        return spark.createDataFrame([], history_schema())
    history = spark.read.schema(history_schema()).option("basePath", root).parquet(*paths)
    return history if namespace is None else history.filter(F.col("namespace") == namespace)
