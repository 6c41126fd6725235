import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from metertide.operators.messages import (
    MESSAGE_DATE,
    ROW_HASH,
    SENT,
    distinct_messages,
    with_sent,
)
from metertide.schemas import MESSAGES
from metertide.sources.files import CSV_FORMAT
from metertide.sources.history import BUCKETS, FIRST_SENT
from metertide.versions import (
    POINTER,
    current_version,
    exists,
    matching,
    modified,
    publish,
    qualified,
    replace_text,
)
from metertide.workspace import delete, new_table


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """A folder of CSV files, each with its header; spaces at the ends of values are kept."""
    df.write.options(**CSV_FORMAT).csv(path, header=header, mode=mode)


def write_scalar(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-value frame as text."""
    (name,) = row.columns
    row.select(F.col(name).cast("string").alias("value")).write.mode(mode).text(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished, not merely begun."""
    return exists(spark, f"{path}/_SUCCESS")


def write_once(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, rebuild: bool = False
) -> DataFrame:
    """Write what ``build`` returns as Parquet and return the written table.

    If ``path`` is complete already, nothing is built, unless ``rebuild`` asks for it. An earlier
    attempt that did not finish is replaced. The path must name everything the result depends on.
    """
    if rebuild or not is_written(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_if_any(df: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Write CSV only if there are rows. ``df`` is read twice, so pass a written table."""
    if df.isEmpty():
        return False
    write_csv(df, path, mode=mode)
    return True


def append_history(
    messages: DataFrame,
    root: str,
    namespace: str,
    run: str,
    on_error: str = "raise",
    buckets: int | None = None,
) -> None:
    """Add one collection run to the history, in folders by namespace, run, version and message date.

    Times are parsed here, once: a malformed one raises, or is null with ``on_error="null"`` and belongs
    to no period. Repeating a run writes a new version beside the old one, which stays current until the
    new one is complete; ``remove_old_versions`` removes what is current no more. The rebalance gathers
    a date's rows into few files and splits a date that is larger than the others.

    With ``buckets`` whole-row duplicates of the run are stored once, and each date lies in so many buckets
    by a hash of the row. Runs with the same number of them then meet without a shuffle
    (``sources.history.read_distinct``), as often as they are read; a row comes at most once per run,
    so none makes a bucket large. Choose the number so that a bucket of the largest period that is read
    at once fits a task.
    """
    for name in (namespace, run):
        if not re.fullmatch(r"[\w.-]+", name, re.ASCII):
            raise ValueError(f"not fit for a folder name: {name!r}")
    spark, version = messages.sparkSession, uuid.uuid4().hex
    folder = f"{root}/namespace={namespace}/run={run}"
    path = f"{folder}/version={version}"
    columns = [*MESSAGES.fieldNames(), SENT]
    day = F.col(SENT).cast("date").alias(MESSAGE_DATE)
    parsed = with_sent(messages, on_error).select(columns)
    if buckets is None:
        dated = parsed.select(*columns, day).hint("rebalance", MESSAGE_DATE)
        dated.write.partitionBy(MESSAGE_DATE).parquet(path)
    else:
        _write_buckets(distinct_messages(parsed).select(*columns, row_hash(), day), buckets, path)
        replace_text(spark, f"{path}/{BUCKETS}", str(buckets))
    replace_text(spark, f"{path}/{FIRST_SENT}", json.dumps(_first_sent(spark, path)))
    publish(spark, folder, version)


def row_hash() -> Column:
    return F.xxhash64(*MESSAGES.fieldNames()).alias(ROW_HASH)


def _write_buckets(rows: DataFrame, buckets: int, path: str) -> None:
    """One file per bucket and date, in folders by date. The catalog names the table while it is written."""
    spark, table = rows.sparkSession, new_table()
    dealt = rows.repartition(buckets, ROW_HASH).write.partitionBy(MESSAGE_DATE)
    try:
        dealt.bucketBy(buckets, ROW_HASH).saveAsTable(table, format="parquet", path=qualified(spark, path))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _first_sent(spark: SparkSession, path: str) -> dict[str, str]:
    """The first time of each date in a written version, one row a date. Rows without a time are left out."""
    written = spark.read.schema(StructType().add(SENT, "timestamp_ntz")).parquet(path)
    firsts = written.filter(F.col(SENT).isNotNull()).groupBy(F.to_date(SENT).alias("date"))
    return {str(row["date"]): str(row["first"]) for row in firsts.agg(F.min(SENT).alias("first")).collect()}


def remove_old_versions(spark: SparkSession, root: str, namespace: str) -> list[str]:
    """Remove versions of runs that are not current and lie there since before the current one became so,
    also broken-off ones. Returns their paths. Readers that still use such a version lose it."""
    removed = []
    for pointer in matching(spark, f"{root}/namespace={namespace}/run=*/{POINTER}"):
        folder = pointer.removesuffix(f"/{POINTER}")
        current = f"version={current_version(spark, folder)}"
        for path in matching(spark, f"{folder}/version=*"):
            if not path.endswith(f"/{current}") and modified(spark, path) <= modified(spark, pointer):
                delete(spark, path)
                removed.append(path)
    return removed
